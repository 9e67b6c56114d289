"""Near duplicates by SimHash, found with deletion variants of fingerprint halves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.join import shuffled
from ..sources.scratch import scope
from .candidates import Filter, components, signed
from .common import all_columns, bit_majority, connected_components, free_names, quoted, save, slices, type_of

#: Of the fingerprints of near_duplicates().
WORDS = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer. Of SEGMENTS halves, one
#: then differs by one bit at most, so both agree in a variant that leaves it out.
DISTANCE = 2
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
#: Buckets of up to so many fingerprints are joined and verified; see _links().
SMALL_BUCKET = 4
#: near_copies() links texts whose sets of shingles of so many words have this Jaccard similarity or more.
COPY_WORDS, SIMILARITY = 5, 0.8
#: Its signatures are SimHashes of sets of words, of LANES times 64 bits, cut into segments of SEGMENT bits, of which one
#: wildcard leaves out WILD neighbouring bits.
LANES, SEGMENT, WILD = 8, 40, 8
#: Texts whose shingles a task remembers while it compares pairs.
REMEMBERED = 64

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """The signed SimHash of a whole text; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))), len(words) - WORDS + 1
    return bit_majority(np.fromiter(map(_hash, shingles), np.uint64, n))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [fingerprint(text) for text in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [*(c for name, c in zip(batch.schema.names, batch.columns) if name != "text"), pa.array(found, pa.int64())],
            names=[*(name for name in batch.schema.names if name != "text"), "fp"],
        )


def with_fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and fp, row by row, as a table that is read many times."""
    schema = ", ".join(f"{k} {type_of(docs, k)}" for k in keys) + ", fp bigint"
    return save(docs.select(*keys, "text").mapInArrow(_fingerprints, schema), "fingerprints")


def variants(prints: DataFrame) -> DataFrame:
    """(fp) -> (fp, key): a key for each segment and each bit that is left out of it."""
    i = F.col("i")
    shift = F.expr(f"cast(i div {WIDTH} as int) * {WIDTH}")
    at = F.expr(f"i % {WIDTH}")
    segment = F.call_function("shiftrightunsigned", F.col("fp"), shift).bitwiseAND(F.lit((1 << WIDTH) - 1))
    above = F.call_function("shiftleft", F.call_function("shiftrightunsigned", segment, at + 1), at)
    below = segment.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at) - 1)
    key = F.call_function("shiftleft", i.cast("bigint"), F.lit(WIDTH - 1)).bitwiseOR(above.bitwiseOR(below))
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * WIDTH - 1))).alias("i")).select(
        "fp", key.alias("key")
    )


def _links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints -> (u, v), enough links for the right components.

    Fingerprints that share a variant are candidates. In buckets of a few they are
    joined and verified. Those of larger buckets (dense groups of near copies)
    instead list themselves and their 64 neighbours at one bit: two fingerprints
    have a common entry exactly if they differ by two bits or fewer, so each
    entry's members hang on its least one, which is linear and loses no link.
    """
    keyed = variants(prints)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    near = save(keyed.join(shared, "key"), "buckets")
    few = near.where(F.col("n") <= SMALL_BUCKET)
    pairs = (
        few.select("key", F.col("fp").alias("u"))
        .join(few.select("key", F.col("fp").alias("v")), "key")
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
        .select("u", "v")
        .distinct()
    )
    one_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i"))
    dense = (
        near.where(F.col("n") > SMALL_BUCKET)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
        .select("fp", F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(one_bit)).alias("entry"))
    )
    least = dense.groupBy("entry").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = dense.join(least, "entry").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return pairs.union(stars.distinct())


def classes(prints: DataFrame) -> DataFrame:
    """A table with fp -> (fp, root) for its distinct fingerprints."""
    # dealt to as many tasks as shuffles have, as each row is to become many
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = save(prints.select("fp").distinct().repartition(parts), "distinct")
    roots = connected_components(_links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, fingerprint, component_id.

    Exact copies collapse to one fingerprint before any search, so a group of any
    size costs one. component_id is the least doc_id that links reach (null only
    where no member has one). Null and empty texts have fingerprint zero and link
    like any other; repeated rows are returned as often as they come; an empty
    table gives an empty result. Other columns are not read.
    """
    prints = with_fingerprints(docs, "doc_id")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = save(classes(prints).join(least, "fp"), "members")
    component = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(shuffled(component), "root").select("fp", "component_id")
    return prints.join(shuffled(named), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def signature(words: list[bytes]) -> np.ndarray:
    """LANES SimHashes of a set of words, each with other hashes."""
    found = list(set(words))
    if not found:
        return np.zeros(LANES, np.int64)
    first = np.fromiter(map(_hash, found), np.uint64, len(found))
    return np.array([bit_majority(_mixed(first, k)) for k in range(LANES)], np.int64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def _signed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with text -> instead of it h, the hash of its words, their number as size, and its signature as lanes."""
    for batch in slices(batches):
        words = [_words(text) for text in batch.column("text").to_pylist()]
        names = [k for k in batch.schema.names if k != "text"]
        values = [pa.array([signed(_name(w)) for w in words], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([signature(w) for w in words], pa.list_(pa.int64()))]
        yield pa.record_batch([*(batch.column(k) for k in names), *values], names=[*names, "h", "size", "lanes"])


def _name(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _wanted_texts(batches: Iterator[pa.RecordBatch], wanted: Filter) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = {signed(h): text for text in batch.column("text").to_pylist() if (h := _name(_words(text))) in wanted}
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array([x or "" for x in found.values()], pa.string())], names=["h", "text"])


def segment_variants(signed_texts: DataFrame) -> DataFrame:
    """(h, lanes) -> (h, key): of each segment, a key for each place of the wildcard."""
    per = 64 * LANES // SEGMENT
    bit = lambda lane, at: F.shiftrightunsigned(F.col("lanes")[lane], at)
    keys = []
    for i in range(per):
        lane, at = divmod(i * SEGMENT, 64)
        value = bit(lane, at)
        if at + SEGMENT > 64:
            value = value.bitwiseOR(F.shiftleft(F.col("lanes")[lane + 1], 64 - at))
        for j in range(SEGMENT // WILD):
            left = ((1 << SEGMENT) - 1) ^ (((1 << WILD) - 1) << WILD * j)
            keys.append(F.xxhash64(value.bitwiseAND(F.lit(left)), F.lit(i * SEGMENT + j)))
    return signed_texts.select("h", F.explode(F.array(*keys)).alias("key"))


def shingles(text: str) -> np.ndarray:
    """The distinct hashes, in order, of a text's shingles of COPY_WORDS words; of the whole sequence if it has fewer."""
    words = _words(text)
    if len(words) < COPY_WORDS:
        return np.array([_hash(b" ".join(words))], np.uint64)
    return np.unique(np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(COPY_WORDS))))), np.uint64, len(words) - COPY_WORDS + 1))


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}

    def of(h: int, text: str) -> np.ndarray:
        if h not in known:
            if len(known) >= REMEMBERED:
                del known[next(iter(known))]
            known[h] = shingles(text)
        return known[h]

    for batch in slices(batches):
        ok = []
        for u, v, a, b in zip(*(batch.column(k).to_pylist() for k in ("u", "v", "a", "b"))):
            x, y = of(u, a), of(v, b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
        yield batch.filter(pa.array(ok, pa.bool_())).select(["u", "v"])


def near_copies(docs: DataFrame, *keys: str) -> DataFrame:
    """docs (keys, text, ...) -> keys, root: the same root for texts that links of similarity connect.

    Texts are taken as their words, lower-cased in A-Z. Texts link at a Jaccard
    similarity of their sets of shingles of COPY_WORDS words of SIMILARITY or more,
    which is computed exactly for candidates: texts that share keys of their
    signatures' segments with a wildcard, see candidates.py. Equal texts are one
    before any search. Texts without a word are alike.
    """
    schema = ", ".join(f"{k} {type_of(docs, k)}" for k in keys) + ", h bigint, size bigint, lanes array<bigint>"
    with scope() as keep:
        prints = save(docs.select(*keys, "text").mapInArrow(_signed_texts, schema), "signatures")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        distinct = save(prints.groupBy("h").agg(F.first("size").alias("size"), F.first("lanes").alias("lanes")).repartition(parts), "distinct")
        items = distinct.select("h", F.col("lanes")[0].alias("sim"), "size")

        def texts(wanted: Filter) -> DataFrame:
            return docs.select("text").mapInArrow(partial(_wanted_texts, wanted=wanted), "h bigint, text string")

        # sizes are words, of which similar sets of shingles may have very different numbers if these repeat
        roots = components(segment_variants(distinct), items, texts, _jaccard, 1.0, 0)
        return keep(save(prints.select(*keys, "h").join(roots, "h", "left").select(*keys, F.coalesce("root", "h").alias("root")), "copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs, one row of each group of near copies; see near_copies().

    The row with the least doc_id stays (rows without an id only in groups that
    have none); among rows that share it, the one with the least text hash, once.
    Null and empty texts are one group. Other columns, of any name, are left as
    they are; an empty table gives an empty result.
    """
    id_, th, own_id, own = free_names(docs, "id", "th", "own_id", "own")
    named = docs.select(*all_columns(docs), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(own_id), F.coalesce(F.xxhash64("text"), F.lit(0)).alias(own))
    grouped = near_copies(named.select("doc_id", F.col(own).alias("th"), "text"), "doc_id", "th")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    kept = grouped.groupBy("root").agg(least).select("least.doc_id", "least.th")
    wanted = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_), F.col("th").alias(th)).distinct()
    rows = named.join(wanted, (quoted(own_id) == quoted(id_)) & (quoted(own) == quoted(th)), "left_semi")
    return rows.dropDuplicates([own_id, own]).select(*all_columns(docs))
