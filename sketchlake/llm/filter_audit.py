"""What each filter removes under every order of the filters, from a packed bitmap index.

Every task packs its rows into NumPy bitsets: one per filter (the rows that fail it), one
per label, and the parts as ranges of bytes (a part's rows begin at a byte; padding bits
belong to no part). For every subset of the filters, taken as the prefix that has been
applied, AND-NOT gives the rows that are left and popcount their numbers per part and label. Only these
counts leave the tasks: 2**filters rows for each part and batch. They are summed, and every
column of the report, for all orders, is a difference of two of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchlake.llm import kernels as K
from sketchlake.llm.runtime import checkpoint, lean, ship

FILTERS = "ABCDE"
#: Groups of equal texts that hold more than 1/HEAVY of all rows; there are fewer than HEAVY, so their first ids can be broadcast.
HEAVY = 4096

_CAPITAL, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN[np.frombuffer(b"#$%&*|", np.uint8)] = True


def _text_failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits 0 to 3: under 100 words; under 80 in 100 words distinct; over 10 in 100 characters capital; holds a sign."""
    for batch in batches:
        bits = np.zeros(batch.num_rows, np.int32)
        for group in K.groups(batch.column("text")):
            found = K.words(group, K.PLAIN)
            n = np.diff(found.bounds)
            distinct = np.array([len(np.unique(found.hash[a:b])) for a, b in itertools.pairwise(found.bounds)])
            count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[group.offsets])
            points = count((group.bytes & 0xC0) != 0x80)
            failed = (n < 100, 100 * distinct < 80 * n, 100 * count(_CAPITAL[group.bytes]) > 10 * points, count(_SIGN[group.bytes]) > 0)
            bits[group.first : group.first + len(group)] = sum(x.astype(np.int32) << i for i, x in enumerate(failed))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "part", "digest")], pa.array(bits)], ["doc_id", "part", "digest", "bits"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, the filters ``A`` to ``E`` (true: the row fails), and the labels ``good`` and ``toxic``, one row per document.

    A null text is empty, a null language the part ''. E holds where a row with a smaller id has the same text anywhere in the table; a
    null id is larger than all others. Rows that share an id and the text are equal in this. Labels join by id: one that says
    quality 1 makes a document good, one that says toxic 1 toxic; further ones change nothing. Other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = rows.mapInArrow(lean(_text_failures), "doc_id long, part string, digest binary, bits int")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = checkpoint(rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"]))
    copied = checkpoint(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    heavy = F.broadcast(copied.where(F.col("n") > rows.count() / HEAVY).select("digest", "first"))  # under HEAVY rows
    # a group with a notable share of the rows meets its first id by broadcast, all others by a join whose keys are small
    single = rows.join(heavy, "digest", "left_anti").join(copied.select("digest", "first"), "digest", "left")
    both = rows.join(heavy, "digest").unionByName(single)
    repeated = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    failed = [(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).alias(f) for i, f in enumerate("ABCD")]
    return both.select("part", *failed, F.coalesce(repeated, F.lit(False)).alias("E"), "good", "toxic")


def _count_prefixes(filters: int, labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            code, bits = coded.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(code, kind="stable")
            size = np.bincount(code, minlength=len(coded.dictionary))
            width = (size + 7) // 8
            start = np.cumsum(width) - width
            place = np.repeat(8 * start - (np.cumsum(size) - size), size) + np.arange(len(code))

            def bitset(rows: np.ndarray, n=int(width.sum()), place=place, order=order) -> np.ndarray:
                plane = np.zeros(8 * n, bool)
                plane[place] = rows[order]
                return np.packbits(plane)

            fails = [bitset(bits >> i & 1) for i in range(filters)]
            marked = [bitset(bits >> (filters + i) & 1) for i in range(labels)]
            left = [bitset(np.ones(len(code), bool))]
            for prefix in range(1, 1 << filters):
                low = (prefix & -prefix).bit_length() - 1
                left.append(left[prefix & (prefix - 1)] & ~fails[low])
            count = lambda held: np.add.reduceat(np.bitwise_count(held), start, dtype=np.int64)
            columns = [[count(rows)] + [count(rows & mark) for mark in marked] for rows in left]
            parts, n = coded.dictionary, len(size)
            arrays = [pa.concat_arrays([parts] * len(left)), pa.array(np.repeat(np.arange(len(left)), n), pa.int32())]
            arrays += [pa.array(np.concatenate([c[i] for c in columns])) for i in range(1 + labels)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "prefix", *[f"n{i}" for i in range(1 + labels)]])

    return run


def prefix_counts(flags: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """``part, prefix, n0, n1, ...``: rows of each part that pass every filter of a subset (a bit per filter), all and those with each label. Null flags are false."""
    ship(flags.sparkSession)
    bits = sum((F.when(F.col(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate([*filters, *labels])), F.lit(0))
    names = [f"n{i}" for i in range(1 + len(labels))]
    counted = flags.select("part", bits.alias("bits")).mapInArrow(_count_prefixes(len(filters), len(labels)), "part string, prefix int, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("part", "prefix").agg(*[F.sum(n).alias(n) for n in names])


def _report(filters: Sequence[str], labels: Sequence[str]):
    steps = [(order, i) for order in itertools.permutations(range(len(filters))) for i in range(len(filters))]
    own = np.array([1 << order[i] for order, i in steps])
    before = np.array([sum(1 << f for f in order[:i]) for order, i in steps])
    whole = (1 << len(filters)) - 1

    def run(counts: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((1 + len(labels), whole + 1), np.int64)
        n[:, counts["prefix"]] = counts[[f"n{i}" for i in range(1 + len(labels))]].to_numpy().T
        removed = n[:, before] - n[:, before | own]
        fails = n[0, 0] - n[0, own]
        out = {"part": counts["part"].iloc[0], "filter_order": ["".join(filters[f] for f in order) for order, _ in steps], "step": [i + 1 for _, i in steps], "kept": n[0, before | own]}
        out |= {"removed": removed[0], "redundant": fails - removed[0], "unique_fails": n[0, whole ^ own] - n[0, whole]}
        out |= {f"{label}_lost": removed[1 + i] for i, label in enumerate(labels)}
        shapley = np.bincount(own, removed[0], whole + 1)  # whole numbers below 2**53
        return pd.DataFrame(out | {"shapley": shapley[own].astype(np.int64)})

    return run


def audit(flags: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """``part, filter_order, step``, and what the step's filter does there, for every part and all orders of the filters.

    ``flags`` has a string column ``part`` and boolean columns: filters (true: fails; single letters) and labels. ``kept``: rows left after
    the step; ``removed`` by it; ``redundant``: fail its filter, but were removed before; ``unique_fails``: fail no other filter;
    ``<label>_lost``: removed with the label; ``shapley``: what the filter removes, summed over all orders. Repeated rows
    count each; an empty table has no parts and gives no rows. A part's report is made from its 2**filters counts.
    """
    names = ["part string, filter_order string, step int", *[f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels], "shapley")]]
    return prefix_counts(flags, filters, labels).groupBy("part").applyInPandas(_report(filters, labels), ", ".join(names))
