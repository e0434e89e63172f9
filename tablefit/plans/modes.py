"""The two one-call modes (readable clean table, numeric training table) and the training frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.exprs import c
from tablefit.operators.clean import dedupe, impute_auto, log_transform, replace
from tablefit.operators.encode import as_text, encode_binary, encode_freq, encode_freq_rank, encode_label, ensure_numeric, one_hot, scale_standard
from tablefit.operators.facts import Facts, as_facts
from tablefit.operators.features import engineer
from tablefit.plans.rules import drop_rules
from tablefit.sources.tables import column_kinds, normalise, settle


def _without(f: Facts, rules: str, target: str) -> DataFrame:
    gone = {r["column"] for r in drop_rules(f, rules, target).collect()}
    return f.df.select(*[c(n) for n in f.columns if n not in gone])


def clean(df, target: str | None = None) -> DataFrame:
    """Readable clean table: duplicates out, identifier, metadata, sparse (> 70 %) and constant
    columns out, gaps filled. Nothing is scaled or encoded."""
    source = df.df if isinstance(df, Facts) else normalise(df)
    target = target or source.columns[-1]
    f = Facts(settle(dedupe(source)))  # several passes follow, so the distinct rows are stored once
    return impute_auto(Facts(_without(f, "clean", target)), target)


def to_ml(df, target: str | None = None) -> DataFrame:
    """All-numeric table without nulls: duplicates out, passenger-style features, drops (> 60 %
    missing, free text), fills, log1p of skewed columns, encodings by cardinality, label-encoded
    text target, standardised features. Statistics of a step are taken after the step before."""
    source = df.df if isinstance(df, Facts) else normalise(df)
    target = target or source.columns[-1]
    f = Facts(engineer(settle(dedupe(source))))
    filled = impute_auto(Facts(_without(f, "ml", target)), target)
    logged = log_transform(Facts(filled), target)
    encoded = ensure_numeric(Facts(encode_by_size(logged, target)), target)
    stored = settle(encoded)  # encoder joins run once; the scaler needs one more pass
    return scale_standard(Facts(stored), [n for n in stored.columns if n != target])


def encode_by_size(df: DataFrame, target: str | None) -> DataFrame:
    """Two values: 0/1; up to 10: one-hot; up to 50: frequency rank; more: frequency share."""
    kinds = column_kinds(df)
    cols = [n for n in df.columns if n != target and kinds[n] in ("string", "boolean")]
    if not cols:
        return df
    df = replace(df, {n: F.trim(as_text(n)) for n in cols})
    distinct = Facts(df.select(*[c(n) for n in cols])).distinct()
    hot = []
    for name in cols:
        k = distinct[name]
        if k == 2:
            df = encode_binary(df, name)
        elif k <= 10:
            hot.append(name)
        elif k <= 50:
            df = encode_freq_rank(df, name)
        else:
            df = encode_freq(df, name)
    return one_hot(df, hot) if hot else df


def training_frame(df, target: str) -> DataFrame:
    """Matrix for model scoring: columns over 60 % missing out, text and booleans label encoded
    (null is its own class), text target encoded, numbers filled by their median."""
    f = as_facts(df)
    keep = [n for n in f.columns if n == target or (f.scan()[n]["missing_share"] <= 0.6 and f.kinds[n] != "datetime")]
    out = f.df.select(*[c(n) for n in keep])
    for name in keep:
        if f.kinds[name] in ("string", "boolean"):
            out = encode_label(out, name)
    gaps = [n for n in keep if f.kinds[n] == "numeric" and n != target and f.scan()[n]["missing"]]
    q = f.quantiles([0.5], gaps) if gaps else {}
    return replace(out, {n: F.coalesce(c(n).cast("double"), F.lit(q[n][0.5])) for n in gaps})
