"""Queries registered with the driver, by area."""

from queryset import drifting, modelling, preparing, profiling, relations

MODULES = [profiling, relations, preparing, drifting, modelling]
