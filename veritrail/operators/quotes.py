"""Where quotes stand in pages, for many quotes at once and without knowing the page: no product of quotes and pages.

Texts are sampled by their content: of the hashes of all strings of ``k`` characters, the least of each ``t`` in a row is kept (winnowing). What is kept
within a quote is kept wherever the quote stands. Each quote takes the first of its own samples, pages all of theirs; equal hashes meet in a
join, and the characters decide. Quotes come in classes by length, each with its own k and t, so that short ones are found, too; classes that no quote
is in cost nothing. Pages are sampled where they lie. Quotes that are few are met there, too; of many, about 2 of t + 1 hashes of the pages go on.

All occurrences are found, overlapping ones too. An empty or null quote stands nowhere; repeated quotes and pages each count; offsets are in characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.pandas.types import to_arrow_schema

#: k and t of the classes, longest first. A quote of k + t - 1 characters or more has a sample.
CLASSES = ((16, 16), (8, 8), (3, 4), (1, 1))
_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def samples(text: str, k: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the samples of a text, in order."""
    codes = _codes(text).astype(np.uint64)
    n = len(codes) - k + 1
    if n < t:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(n, np.uint64)
    for i in range(k):
        hashes = hashes * _U(_FACTOR) + codes[i : i + n] + _U(1)
    hashes = _mixed(hashes)
    # The least of each window, the first of equal ones, by windows that double; its place never goes back.
    least, width = np.arange(n), 1
    while width < t:
        step = min(width, t - width)
        one, two = least[:-step], least[step:]
        least, width = np.where(hashes[two] < hashes[one], two, one), width + step
    at = least[np.r_[True, least[1:] != least[:-1]]]
    return at, hashes[at]


def class_of(length: Column) -> Column:
    """The class of a quote of that length."""
    out = F.lit(None).cast("int")
    for i, (k, t) in reversed(list(enumerate(CLASSES))):
        out = F.when(length >= k + t - 1, i).otherwise(out)
    return out


def _sampled(frame: DataFrame, keys: list[str], text: str, first: bool, classes: list[int] | None = None) -> DataFrame:
    """keys, class, hash and place of the samples of each text (first: the first one, in the text's own class)."""
    given = frame.select(F.struct(*keys).alias("key"), F.col(text).alias("text"), class_of(F.length(text)).alias("class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (value, own) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                for c in ([own] if first else classes) if value.is_valid and own is not None else []:
                    at, hashes = samples(value.as_py(), *CLASSES[c])
                    at, hashes = (at[:1], hashes[:1]) if first else (at, hashes)
                    key = b.column(0).take(pa.array(np.full(len(at), i)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(at), c, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32))], ["key", "class", "hash", "place"])

    key = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"key {key}, class int, hash long, place int").select("key.*", "class", "hash", "place")


#: Quotes, and characters of them, up to which each task holds them all and looks for them where the pages lie.
QUOTES_HELD, CHARACTERS_HELD = 1 << 16, 1 << 24
#: Characters of a quote that are compared for all candidates of a page at once.
HEAD = 8


def _found_in_place(held: pa.Table, pages: DataFrame, quote_keys: list[str], page_keys: list[str], text: str, kinds: Ty.StructType) -> DataFrame:
    """quote_keys, page_keys and offset where the held quotes (quote_keys, class, hash, place, _quote) stand: what goes on are hits alone."""
    keys = held.select(quote_keys).combine_chunks()
    ins, quotes = held.column("place").to_numpy(), held.column("_quote").to_pylist()
    lengths = np.array([len(q) for q in quotes], np.int64)
    begins = np.zeros((len(quotes), HEAD), np.uint32)
    for i, q in enumerate(quotes):
        begins[i, : min(len(q), HEAD)] = _codes(q[:HEAD])
    classes, hashes = held.column("class").to_numpy(), held.column("hash").to_numpy().view(np.uint64)
    by_class = {}
    for c in np.unique(classes).tolist():
        own = np.flatnonzero(classes == c)
        own = own[np.argsort(hashes[own], kind="stable")]
        by_class[c] = own, hashes[own]
    given = Ty.StructType([*(kinds[k] for k in quote_keys), *(pages.schema[k] for k in page_keys), Ty.StructField("offset", Ty.IntegerType())])
    schema = to_arrow_schema(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, value in enumerate(b.column(b.num_columns - 1)):
                page = value.as_py()
                which, where = [], []
                codes = _codes(page) if page else None
                for c, (own, wanted) in by_class.items() if page else ():
                    at, met = samples(page, *CLASSES[c])
                    low, many = np.searchsorted(wanted, met), np.searchsorted(wanted, met, "right")
                    hit = np.flatnonzero(low < many)
                    low, many = low[hit], many[hit] - low[hit]
                    q = own[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    offset = np.repeat(at[hit], many) - ins[q]
                    fits = (offset >= 0) & (offset + lengths[q] <= len(codes))
                    q, offset = q[fits], offset[fits]
                    # The first characters of all candidates at once, the rest of what is left one by one.
                    for j in range(HEAD):
                        same = (lengths[q] <= j) | (codes[np.minimum(offset + j, len(codes) - 1)] == begins[q, j])
                        q, offset = q[same], offset[same]
                    long = np.flatnonzero(lengths[q] > HEAD)
                    lost = [x for x in long.tolist() if not page.startswith(quotes[q[x]], int(offset[x]))]
                    which.append(np.delete(q, lost))
                    where.append(np.delete(offset, lost))
                which, where = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, where))
                if len(which):
                    page_key = b.select(list(range(b.num_columns - 1))).take(pa.array(np.full(len(which), i)))
                    columns = [*(c.combine_chunks() for c in keys.take(pa.array(which)).columns), *page_key.columns, pa.array(where, pa.int32())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pages.select(*page_keys, text).mapInArrow(run, given)


def occurrences(quotes: DataFrame, pages: DataFrame, quote_keys: list[str], page_keys: list[str], quote: str = "quote", text: str = "text") -> DataFrame:
    """quote_keys, page_keys and offset (from 0) of every place where a quote stands in a page. Keys of one name must not be on both sides.

    Where the quotes are few enough to be held (``QUOTES_HELD``, ``CHARACTERS_HELD``), pages are searched where they lie, and neither texts nor samples
    move; the result is the same.
    """
    if both := set(quote_keys) & set(page_keys):
        raise ValueError("keys on both sides: " + ", ".join(sorted(both)))
    size = F.length(quote)
    sizes = quotes.where(size > 0).groupBy(class_of(size).alias("c")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()  # of four at most
    asked = _sampled(quotes, [*quote_keys, quote], quote, True)
    if sum(r["n"] for r in sizes) <= QUOTES_HELD and sum(r["size"] for r in sizes) <= CHARACTERS_HELD:
        held = asked.withColumnRenamed(quote, "_quote").distinct()
        return _found_in_place(held.toArrow(), pages, quote_keys, page_keys, text, held.schema).distinct()
    used = sorted(r["c"] for r in sizes)
    asked = asked.select(*quote_keys, "class", "hash", F.col("place").alias("_in"))
    met = _sampled(pages, page_keys, text, False, used).join(asked, ["class", "hash"]).withColumn("offset", F.col("place") - F.col("_in")).where("offset >= 0")
    met = met.select(*quote_keys, *page_keys, "offset").distinct()
    # A key that is there with several texts meets each of them; the last step leaves each hit once.
    met = met.join(quotes.select(*quote_keys, F.col(quote).alias("_quote")), quote_keys).join(pages.select(*page_keys, F.col(text).alias("_text")), page_keys)
    there = F.substring(F.col("_text"), F.col("offset") + 1, F.length("_quote")) == F.col("_quote")
    return met.where(there).select(*quote_keys, *page_keys, "offset").distinct()
