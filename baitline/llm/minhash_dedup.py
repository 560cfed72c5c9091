"""MinHash near-dedup (op2): a signature-coordinate inverted join.

A document's set is that of its 5-word shingles (64-bit hashes; of fewer words,
the whole sequence). Documents with equal sets are one class. A class has 128
min-hashes; each of 72 coordinates is the hash of 4 of them, so the posting list
of a coordinate and value holds near copies and little else, even where a
passage is in a third of all documents.

Two classes of similarity 0.75 agree in 22 coordinates on average, in fewer than
2 with a probability of about 1e-7, so the last coordinate is not posted (prefix).
One shared list makes a pair; its shared lists are not counted. In place of the
count, the signatures of pairs that meet are compared, and those that agree in
under 28 of the first 64 min-hashes (expected: 48, standard deviation 3.5) are
skipped.

A list does not emit its pairs. First each class meets only the list's hub, the
class that collides with others most often (the original of near copies), of its
hubs the one that agrees most and the one that collides most, and confirmed links
give components. The classes around one hub are a group: they are compared by what
tells each of them from the hub (``_within_groups``), so the pairs of a large group
of near copies, edited each in its own places, do not meet at all.
Then lists with two components or more emit the pairs between components and
groups, which are confirmed too; pairs within a component cannot change it. A long one of these
lists, as a common passage makes among short documents, is posted anew under the
rarest shingles of its members: in an order of all shingles by how many members
hold them, two sets of similarity 0.75 meet in the first quarter of either, so a
passage's shingles, last in that order, bring nothing together unless they are
most of a set. What follows a shared shingle bounds the intersection, and pairs
whose bound is too low are skipped; both steps are exact. All links are confirmed
on full sets: 100 * intersection >= 75 * union.

Nulls: a null text or one without words has an empty set and no link. A row
without a doc_id can link others; it is kept if nothing with a doc_id is
reachable. Repeated rows give a row each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from baitline.llm import words as Wd
from baitline.llm.components import components
from baitline.session import materialize

SHINGLE = 5
HASHES, COORDINATES, TAKE = 128, 72, 4
AGREE, SHOWN, LEAST_HASHES = 2, 64, 28     # of the first SHOWN min-hashes, so many must agree
ROWS = 128      # texts, sets and signatures that a task's Python holds at once
LONG = 64       # lists over LONG classes are posted anew, under rare shingles
PERCENT = 75
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64)
_PICK = np.stack([_rng.choice(HASHES, TAKE, replace=False) for _ in range(COORDINATES)])


def shingle_set(text) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not isinstance(text, str):
        return np.empty(0, np.uint64)
    canon = b" ".join(text.encode("utf-8", "surrogatepass").translate(UPPER).split())
    h = Wd.word_hashes(canon)
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return Wd.mix(Wd.gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(Wd.gram_hashes(h, SHINGLE))


def signature(s: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each least hash."""
    least = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(s), ROWS):
        least = np.minimum(least, (s[at:at + ROWS, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _parts(batches):
    """The batches in parts of ROWS rows: a batch of 10,000 texts, as strings
    and with their sets, is several times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sketch(text) -> tuple:
    s = shingle_set(text)
    return (len(s), _digest(s), signature(s).tobytes()) if len(s) else (0, None, None)


def _described(batches):
    for part in _parts(batches):
        n, digest, sig = zip(*(_sketch(t.as_py()) for t in part["text"]))
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                          pa.array(sig, pa.binary())], ["doc_id", "key", "n_shingles", "digest", "sig"])


def _lists(batches):
    """(list, cid): a class under each posted coordinate and value."""
    posted = COORDINATES - AGREE + 1
    for part in _parts(batches):
        sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        key = np.arange(posted, dtype=np.uint64)[None, :] * np.uint64(0x94D049BB133111EB)
        for t in range(TAKE):
            key = Wd.mix(key * Wd.MULT + sig[:, _PICK[:posted, t]])
        cid = np.repeat(part["cid"].to_numpy(zero_copy_only=False), posted)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(cid)], ["list", "cid"])


def _sets(batches):
    """(cid, s) of the texts whose set has the digest asked for."""
    for part in _parts(batches):
        got = [(c, s) for c, t, d in zip(part["cid"].to_pylist(), part["text"], part["digest"].to_pylist())
               if _digest(s := shingle_set(t.as_py())) == d]
        cid, s = zip(*got) if got else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))], ["cid", "s"])


def _by_rarity(items: DataFrame, *key: str) -> DataFrame:
    """(cid, g): the items of each class that others hold too, the rarest first."""
    held = materialize(items.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "held")
    return items.join(held, list(key)).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("g"))


def _rare_lists(long: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(list, cid, root, rest): the classes of long lists under the shingles
    of their prefixes; rest: how many of a class's shingles come from there on.
    Shingles of one member only come first in the order and are not posted."""
    who = materialize(long.select("cid", "root").distinct(), "long")
    grams = materialize(_full_sets(who.select("cid"), classes, docs).select("cid", F.explode("s").alias("list")), "grams")
    shared = _by_rarity(grams, "list")
    size, shown = F.col("n_shingles"), F.size("g")
    first = size - F.ceil(size * PERCENT / 100) + 1 - (size - shown)       # of the prefix, those not alone
    posted = (shared.join(classes.select("cid", "n_shingles"), "cid").where(first > 0)
              .select("cid", shown.alias("m"), F.posexplode(F.slice("g", F.lit(1), F.least(first, shown).cast("int"))).alias("at", "x")))
    return posted.join(who, "cid").select(F.col("x.list").alias("list"), "cid", "root", (F.col("m") - F.col("at")).alias("rest"))


def _mixed(member: DataFrame) -> DataFrame:
    """The rows of the lists with two components or more, with main (of the
    list's largest one) and n (classes of the list)."""
    count = member.groupBy("list", "root").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("list").agg(F.max_by("root", F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots"),
                                     F.sum("n").alias("n")).where("roots > 1").drop("roots")
    own = member.join(materialize(main, "lists"), "list")
    return materialize(own.select(*member.columns, (F.col("root") == F.col("m")).alias("main"), "n"), "members")


@F.pandas_udf(IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), np.uint32).reshape(-1, SHOWN)
    y = np.frombuffer(b"".join(b), np.uint32).reshape(-1, SHOWN)
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


# else the filter on it is pushed below the projection, and every pair is compared twice
_agreeing = _agreeing.asNondeterministic()


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures allow a link, with ``agree``."""
    c = classes.select("cid", F.substring("sig", 1, 4 * SHOWN).alias("sig"), "n_shingles")
    j = (pairs.join(c.toDF("u", "su", "nu"), "u").join(c.toDF("v", "sv", "nv"), "v")
         .where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * PERCENT))
    return j.withColumn("agree", _agreeing("su", "sv")).where(F.col("agree") >= LEAST_HASHES).select("u", "v", "agree")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def _full_sets(asked: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, s): the shingle sets of the classes ``asked``, computed anew from
    a document that stands for the class."""
    # a class's first document, by its text's hash too: ids may be null or repeated
    there = asked.join(classes, "cid").select("cid", "digest", "key", F.col("least").alias("doc_id"))
    rows = _rows(docs)
    got = (rows.join(there, (rows["key"] == there["key"]) & rows["doc_id"].eqNullSafe(there["doc_id"])).select("cid", "digest", "text")
           .mapInArrow(_sets, "cid long, s array<long>"))
    return materialize(got.groupBy("cid").agg(F.first("s").alias("s")), "sets")


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` with the full sets of their classes, a of u and b of v."""
    pairs = materialize(pairs, "pairs")
    asked = pairs.select(F.col("u").alias("cid")).union(pairs.select(F.col("v").alias("cid"))).distinct()
    got = _full_sets(asked, classes, docs)
    return pairs.join(got.toDF("u", "a"), "u").join(got.toDF("v", "b"), "v")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links on the full sets."""
    # compared a row at a time, without batches of sets
    both = F.size(F.array_intersect("a", "b"))
    return (_compared(pairs.select("u", "v"), classes, docs)
            .where(both * (100 + PERCENT) >= PERCENT * (F.size("a") + F.size("b"))).select("u", "v"))


def _with_hubs(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (u a hub) with o, the size of u's set, diff, what is in one
    set of u and v only, and weight: 100 for each element of u's set that v lacks,
    PERCENT for each that v has and u lacks. The pair is a link if weight is
    (100 - PERCENT) * o at most."""
    less, more = F.array_except("a", "b"), F.array_except("b", "a")
    return materialize(_compared(pairs, classes, docs).select(
        *pairs.columns, F.size("a").alias("o"), F.concat(less, more).alias("diff"),
        (F.size(less) * 100 + F.size(more) * PERCENT).alias("weight")), "differences")


def _within_groups(diffs: DataFrame, label: DataFrame) -> DataFrame:
    """(u, v): pairs of classes of one hub that may be links, at least one of
    them no link of the hub. With k elements in both differences from the hub,
    two classes are linked if k * (100 + PERCENT) >= the sum of their weights -
    (100 - PERCENT) * o: the further they are from the hub, the more must be the
    same. The lighter one of a pair is posted under a prefix of its difference,
    rarest first, long enough to hold one of the k; the other one, which is not
    linked to the hub, under all of it."""
    spare = F.col("o") * (100 - PERCENT)
    far = F.col("weight") > spare
    with_far = diffs.where(far).select("hub").distinct()
    member = materialize(diffs.join(with_far, "hub"), "grouped")
    items = materialize(member.select("hub", "cid", F.explode("diff").alias("list")), "items")
    shown = F.size("g")
    least = F.ceil((F.col("weight") + F.greatest(F.col("weight"), spare + 1) - spare) / (100 + PERCENT))
    posted = materialize(
        _by_rarity(items, "hub", "list").join(member.select("hub", "cid", "o", "weight"), "cid").where(far | (shown >= least))
        .select("hub", "cid", "weight", spare.alias("spare"), (shown - least + 1).alias("first"), shown.alias("m"), F.posexplode("g").alias("at", "x"))
        .join(label.withColumnRenamed("id", "cid"), "cid", "left")
        .select("hub", "cid", "weight", "spare", F.coalesce("root", "cid").alias("root"), F.col("x.list").alias("list"),
                (F.col("at") < F.col("first")).alias("prefix"), (F.col("m") - F.col("at")).alias("rest")), "posted")
    a, b = posted.where("prefix").alias("a"), posted.where("weight > spare").alias("b")
    lighter = F.struct("a.weight", "a.cid") < F.struct("b.weight", "b.cid")
    enough = F.least("a.rest", "b.rest") * (100 + PERCENT) >= F.col("a.weight") + F.col("b.weight") - F.col("a.spare")
    return (a.join(b, ["hub", "list"]).where(lighter & enough & F.expr("a.root <> b.root"))
            .select(F.least("a.cid", "b.cid").alias("u"), F.greatest("a.cid", "b.cid").alias("v")).distinct())


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, root, component_id, kept); key: the text's
    hash, root: the component itself, null without words. Ids may be those of
    several components."""
    described = materialize(_rows(docs).mapInArrow(_described, "doc_id long, key long, n_shingles long, digest binary, sig binary"), "signatures")
    classes = (described.where("digest is not null").groupBy("digest")
               .agg(F.min("doc_id").alias("least"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    # numbers are fixed once written
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    posted = classes.select("cid", "sig").mapInArrow(_lists, "list long, cid long")
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = materialize(posted.join(materialize(sizes, "lists"), "list"), "postings")
    # a list's hub: the class that meets others most often, as the original of near copies does
    central = materialize(posted.groupBy("cid").agg(F.sum("n").alias("met")), "met")
    hubs = (posted.join(central, "cid").groupBy("list")
            .agg(F.max_by("cid", F.struct("met", -F.col("cid"))).alias("hub")))
    pairs = posted.join(materialize(hubs, "hubs"), "list").where("hub <> cid")
    first = _promising(pairs.select(F.col("hub").alias("u"), F.col("cid").alias("v")).distinct(), classes)
    # the most like hub of each class, and its group: the hub that meets others most often
    near = materialize(first.join(central.toDF("u", "met"), "u").groupBy("v")
                       .agg(F.max_by("u", F.struct("agree", -F.col("u"))).alias("best"),
                            F.max_by("u", F.struct("met", -F.col("u"))).alias("hub")), "near")
    tried = near.select(F.explode(F.array_distinct(F.array("best", "hub"))).alias("u"), "v", "hub")
    diffs = _with_hubs(tried, classes, docs)
    links = materialize(diffs.where(F.col("weight") <= F.col("o") * (100 - PERCENT)).select("u", "v"), "links")
    label = components(links)
    group = near.select(F.col("v").alias("cid"), "hub")
    within = _within_groups(diffs.where("u = hub").withColumnRenamed("v", "cid"), label)

    # pairs between components: every class outside its list's main component against the others
    root = F.coalesce("root", "cid")
    member = materialize(posted.join(label.withColumnRenamed("id", "cid"), "cid", "left").select("list", "cid", root.alias("root")), "members")
    member = _mixed(member)
    rare = _mixed(materialize(_rare_lists(member.where(F.col("n") > LONG), classes, docs), "rare"))
    sizes = classes.select("cid", F.col("n_shingles").alias("size"))
    whole = member.where(F.col("n") <= LONG).join(sizes, "cid").withColumn("rest", F.col("size"))
    member = materialize(whole.unionByName(rare.join(sizes, "cid")).join(group, "cid", "left"), "members")
    out, all_ = member.where("not main").alias("a"), member.alias("b")
    # an intersection is at most what comes from the shared place on
    enough = F.least("a.rest", "b.rest") * (100 + PERCENT) >= (F.col("a.size") + F.col("b.size")) * PERCENT
    apart = F.expr("a.root <> b.root and (b.main or a.cid < b.cid) and not coalesce(a.hub = b.hub, false)")
    cross = (out.join(all_, "list").where(apart & enough)
             .select(F.least("a.cid", "b.cid").alias("u"), F.greatest("a.cid", "b.cid").alias("v")).distinct())
    tried = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    cross = _promising(cross.join(tried, ["u", "v"], "left_anti").union(within), classes)
    more = materialize(_confirmed(cross, classes, docs), "links")
    if not more.isEmpty():
        label = components(links.union(more))

    named = classes.select("cid", "digest", "least").join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", root)
    small = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.select("digest", "root").join(small, "root").select("digest", "root", "component_id"), "component-names")
    got = described.select("doc_id", "key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    got = got.withColumn("component_id", component)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return got.select("doc_id", "key", "n_shingles", "root", "component_id", kept.alias("kept"))


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    return linked(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
