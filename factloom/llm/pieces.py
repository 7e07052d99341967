"""SentencePiece encoding and decoding through a table of distinct marked words.

A sentencepiece model writes blanks as the marker U+2581 and puts one before the text. If no piece of its vocabulary holds
a marker after another character, no piece can cross the place where a marker follows one; a text then falls into
chunks, each a run of markers and what follows up to the next marker, and the segmentation of a text is that of its
chunks, one after the other. `crosses` looks at the whole vocabulary for pieces that would break this.

Each Python worker keeps a table from distinct chunk to its ids. A batch of texts is cut into chunks; those
that the table lacks are segmented by the library, once each; the ids of a text are joined back from the table by the
chunks' positions. A table that holds `most` characters is begun anew, so memory is bounded and no vocabulary of the
corpus is shuffled, broadcast or kept whole. A task that is lost is simply run again.

What the table may not answer is given to the library whole: texts of a model with crossing pieces, and texts
with a chunk that the model's normaliser would change. The results equal the library's in every case.

Defined results: a null or empty text has no ids and decodes to the empty text, null ids decode as none; repeated
rows are encoded each; a very long chunk is segmented whole and not kept; texts of any length are taken whole; ties are the
library's. Other columns stay, but for those of the names that are added. No rows give no rows.
"""

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from factloom.llm.common import unpacked

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
#: Rows of a batch that are encoded together, characters of the table, and of a chunk that it keeps.
ROWS, MOST, LONGEST = 256, 8_000_000, 1_000


def crosses(pieces: list[str]) -> list[str]:
    """The pieces that hold a marker after another character."""
    inner = re.compile(f"[^{MARKER}]{MARKER}")
    return [p for p in pieces if inner.search(p)]


class ChunkTable:
    """Ids of texts as bytes of 32-bit integers, over the table of distinct chunks."""

    def __init__(self, path: str, most: int = MOST, longest: int = LONGEST):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = bool(crosses([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]))
        self.most, self.longest, self.size, self.ids = most, longest, 0, {}
        self.segmented = 0
        # A marker alone is what an ending blank adds to a text.
        self.blank = self._pack(self.model.encode("a ")[len(self.model.encode("a")) :])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def _segment(self, chunks: list[str]) -> dict[str, bytes | None]:
        """Ids of chunks; the library puts the first marker back. None where the normaliser changes the chunk."""
        self.segmented += len(chunks)
        bare = [c[1:] for c in chunks]
        found = zip(chunks, bare, self.model.encode(bare, num_threads=1))
        return {c: (self.blank if c == MARKER else self._pack(ids) if self.model.normalize(b) == c else None) for c, b, ids in found}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [self._pack(ids) for ids in self.model.encode(texts, num_threads=1)]
        cut = [CHUNK.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        if self.size > self.most:
            self.size, self.ids = 0, {}
        new = list(set().union(*cut).difference(self.ids))
        known = self._segment([c for c in new if len(c) <= self.longest])
        self.ids |= known
        self.size += sum(map(len, known))
        once = self._segment([c for c in new if len(c) > self.longest])
        of = {**once, **self.ids}.__getitem__ if once else self.ids.__getitem__
        out = []
        for text, chunks in zip(texts, cut):
            parts = list(map(of, chunks))
            out.append(self._pack(self.model.encode(text)) if None in parts else b"".join(parts))
        return out


@functools.cache
def chunk_table(path: str) -> ChunkTable:
    """One for all tasks that a Python worker runs."""
    return ChunkTable(path)


def _lists(raws: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(r) // 4 for r in raws)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raws), np.int32), pa.int32()))


def _mapped(df: DataFrame, column: str, added: str, kind, make, keep: bool) -> DataFrame:
    """df with the column `added`, which make(values) gives for the values of `column`, and without that one if not kept."""
    columns = [c for c in df.columns if keep or c.lower() != column.lower()]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{column}`").alias("_given"))
    schema = StructType([rows.schema["row"], StructField("_made", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column("row"), make(batch.column("_given"))], names=["row", "_made"])

    return unpacked(rows.mapInArrow(run, schema), columns, {added: F.col("_made")})


def encode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids", keep: bool = True) -> DataFrame:
    """docs with the ids of every whole text, without begin or end ids; the texts themselves go if not kept."""
    return _mapped(docs, text, ids, ArrayType(IntegerType()), lambda texts: _lists(chunk_table(model)([t or "" for t in texts.to_pylist()])), keep)


def decode(docs: DataFrame, model: str, *, ids: str = "ids", text: str = "decoded", keep: bool = True) -> DataFrame:
    """docs with the text that the ids decode to, by the library."""

    def make(lists: pa.ListArray) -> pa.Array:
        back = chunk_table(model).model.decode
        if lists.flatten().null_count:
            found = [[i for i in x or [] if i is not None] for x in lists.to_pylist()]
        else:
            flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            found = (flat[a:b].tolist() for a, b in zip(ends, ends[1:]))
        return pa.array([back(ids) if ids else "" for ids in found], pa.string())

    return _mapped(docs, ids, text, StringType(), make, keep)
