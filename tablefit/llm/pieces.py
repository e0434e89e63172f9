"""SentencePiece encoding and decoding with a distinct-chunk table.

Pieces of the model hold the white-space mark only in front, so no merge crosses from a character
to a following mark. A text is therefore cut before every run of marks; each task keeps a table of
the distinct marked words it has met, segments each once, and joins the ids back by position.
Decoding is per chunk too: the text is the chunks' texts in order without the first mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import fields, need, text_of

ROOM = 64 << 20   # bytes of chunks that a task remembers before it starts its table afresh
SLICE = 1 << 18   # characters of text that are encoded at a time
ENTRY = 300       # bytes of an entry besides its texts
CHUNK = re.compile(r" +[^ ]*|[^ ]+")  # a run of marks and what follows up to the next; the first may have no mark


class ChunkTable:
    """Segments each distinct chunk once. Loaded in the task from the path of the model. Keys are the chunks
    themselves; those that open a text are kept apart, because only there the model adds a mark."""

    def __init__(self, model: str, decimal: bool, room: int = ROOM):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.model.get_piece_size()):
            if "▁" in self.model.id_to_piece(i).lstrip("▁"):
                raise ValueError("a piece of this model crosses a white-space mark")
        self.seen: dict[bool, dict[str, tuple[int, bytes, str]]] = {True: {}, False: {}}
        self.decimal, self.room, self.held = decimal, room, 0
        self.end = self.stored([self.model.eos_id()])

    def stored(self, ids: list[int]) -> bytes:
        return " ".join(map(str, ids)).encode() if self.decimal else np.array(ids, np.int32).tobytes()

    def learn(self, chunks: set[str], opens: bool) -> None:
        seen = self.seen[opens]
        new = [c for c in chunks if c not in seen]
        if not new:
            return
        # the library adds one mark in front; a chunk inside a text brings its own
        texts = new if opens else [c[1:] for c in new]
        ids = self.model.encode(texts, num_threads=1)
        for chunk, text, own, back in zip(new, texts, ids, self.model.decode(ids, num_threads=1)):
            if text == "":  # a mark alone, not added by the library for empty input
                own, back = [self.model.piece_to_id("▁")], ""
            entry = (len(own), self.stored(own), back if opens else " " + back)
            seen[chunk] = entry
            self.held += ENTRY + 4 * len(chunk) + len(entry[1]) + 4 * len(entry[2])

    def rows(self, texts: list[str]):
        """For each text: number of ids, ids as stored, decoded text."""
        if self.held > self.room:
            self.seen, self.held = {True: {}, False: {}}, 0
        cut = [CHUNK.findall(t.replace("▁", " ")) for t in texts]
        self.learn({c[0] for c in cut if c}, True)
        inner = set()
        for c in cut:
            inner.update(c[1:])
        self.learn(inner, False)
        first, rest = self.seen[True], self.seen[False]
        for c in cut:
            own = [rest[x] for x in c[1:]]
            if c:
                own.insert(0, first[c[0]])
            joined = [x[1] for x in own]
            joined.append(self.end)
            yield sum(x[0] for x in own) + 1, (b" " if self.decimal else b"").join(joined), "".join([x[2] for x in own])


def _encode(model: Callable[[], str] | str, digest: bool, room: int):
    kind = pa.string() if digest else pa.list_(pa.int32())
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]

    def run(batches):
        table = ChunkTable(model() if callable(model) else model, digest, room)
        for batch in batches:
            row, text = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < SLICE):
                    part.append(text[at + len(part)].as_py())
                    size += len(part[-1])
                n, ids, decoded = zip(*table.rows(part))
                if digest:
                    ids, decoded = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                else:
                    ids = [np.frombuffer(x, np.int32) for x in ids]
                cols = [pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([row.slice(at, len(part)), *cols], names=["row", *names])
                at += len(part)

    return run


def encode(df: DataFrame, model: Callable[[], str] | str, text: str = "text", keep: list[str] | None = None, digest: bool = False, room: int = ROOM) -> DataFrame:
    """Add n_tokens, ids (closed by the end id) and decoded text, or their SHA-256 with ``digest``.

    ``model`` is the path of the model file, or a function that gives it on the executor. A null
    text counts as empty: the end id alone. Every row is encoded on its own, whole, whatever its
    length; memory is that of a slice of the batch, the longest text and a table of about ``room`` bytes,
    which changes no result. Repeated rows give repeated results.
    """
    keep = df.columns if keep is None else keep
    # other columns travel as one struct, whatever their names
    slim = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(df, text).alias("text"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"
    found = slim.mapInArrow(_encode(model, digest, room), fields([slim.schema["row"]], out))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *found.columns[1:])


def public_model() -> str:
    """Where the public 32k BPE model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded_documents(docs: DataFrame, model: Callable[[], str] | str = public_model) -> DataFrame:
    """The contract of op9."""
    need(docs, "doc_id", "text")
    return encode(docs, model, keep=["doc_id"], digest=True)
