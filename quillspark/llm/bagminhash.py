"""Near-duplicate detection with BagMinHash signatures.

Each text is a multiset of word shingles.  A signature register keeps the earliest point of
Poisson processes over (time, weight): every shingle has one process for each dyadic level of
discretised weight below its count, so two signatures agree in a register with probability equal
to the weighted Jaccard similarity.  Points come in ascending time and a text stops drawing them
once no register can change, so a signature costs about (elements + m log m) points.

Exact copies form classes first; one representative of each goes on.  Signatures are cut into
bands; buckets of more than a few members are also divided by further bands.  A bucket's members
are compared with its most central one.  Where verified links leave a bucket in several components,
members of different components are compared, in salted blocks: by signatures first, then by exact
multiset overlap.  Members of its largest component stay in one block each and are visited by the
others.  A block gives no more links than members, so rows stay in proportion.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import Scratch, heavy_keys, joined_on, written
from quillspark.llm.components import components

REGISTERS = 128
BANDS, ROWS = 25, 5
SHINGLE = 5
SIMILARITY = 0.8
#: Buckets of more members are divided by further bands.
SMALL_BUCKET = 4
FURTHER_BANDS = 4
#: Members of a block, and distinct shingles of its members, about.
BLOCK, BLOCK_SHINGLES = 1024, 3_000_000
#: Registers that one step of comparing signatures holds.
STEP = 1 << 25
#: Four standard deviations below the threshold: pairs estimated lower aren't verified by default; an
#: estimate of 0 verifies every pair that shares a band.
ESTIMATE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5

_U = np.uint64


def _levels(bag: tv.Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, level's lower bound, width, level number): one row for each process of an entry.
    Level 0 is (0, 1], level k is (2^(k-1), 2^k]."""
    top = np.ceil(np.log2(np.maximum(bag.count, 1))).astype(np.int64)  # levels 0..top
    entry = np.repeat(np.arange(len(bag.count)), top + 1)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    return entry, low, np.where(level == 0, 1.0, low), level


def signatures(bag: tv.Bags, rows: int, m: int = REGISTERS) -> np.ndarray:
    """(rows, m) 16-bit signatures; a row without elements is all zero."""
    entry, low, width, level = _levels(bag)
    row, weight = bag.row[entry], bag.count[entry]
    with np.errstate(over="ignore"):
        state = tv.mix(bag.hash[entry] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    first = np.full(rows * m, np.inf)
    t = np.zeros(len(entry))
    last = np.full(rows, np.inf)
    for i in itertools.count(1):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            r = tv.mix(state + _U(2 * i) * _U(0xD1B54A32D192ED03))
            place = tv.mix(r + _U(0x8CB92BA72F3D8DD7))
        t = t - np.log1p(-((r >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        at = low + width * ((place >> _U(32)).astype(np.float64) * 2.0**-32)
        good = at < weight
        np.minimum.at(first, row[good] * m + ((place & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)[good], t[good])
        if i < 4 or i % 4 == 0:
            last = first.reshape(rows, m).max(axis=1) if rows else last
        on = t < last[row]
        if not on.all():
            row, weight, state, t, low, width = row[on], weight[on], state[on], t[on], low[on], width[on]
    out = (tv.mix(first.view(_U)) >> _U(48)).astype(np.uint16).reshape(rows, m)
    out[np.diff(bag.ptr) == 0] = 0
    return out


def class_keys(w: tv.Words, bag: tv.Bags) -> list[bytes]:
    """128-bit hash of each row's multiset; of a row without words, that of its bytes."""
    with np.errstate(over="ignore"):
        mixed = tv.mix(bag.hash * _U(3) + bag.count.astype(_U) * _U(0x9E3779B97F4A7C15))
        other = tv.mix(mixed ^ _U(0xC2B2AE3D27D4EB4F))
    keys = np.zeros((w.rows, 2), _U)
    full = np.flatnonzero(np.diff(bag.ptr))
    if len(full):
        with np.errstate(over="ignore"):
            keys[full, 0] = tv.mix(np.add.reduceat(mixed, bag.ptr[full]) + _U(1))
            keys[full, 1] = tv.mix(np.add.reduceat(other, bag.ptr[full]) + _U(2))
    for i in np.flatnonzero(np.diff(bag.ptr) == 0).tolist():
        raw = w.data[w.offsets[i] : w.offsets[i + 1]]
        with np.errstate(over="ignore"):
            h = np.add.reduce(tv._BYTE[raw] * tv.powers(len(raw) + 1)[: len(raw)]) if len(raw) else _U(0)
            keys[i] = tv.mix(np.array([h, h + _U(7)]) + _U(len(raw) + 3))
    return [k.tobytes() for k in keys]


def _sign(text: str):
    def run(batches):
        for batch in batches:
            for w in tv.pieces(batch.column(batch.schema.names.index(text))):
                bag = tv.shingles(w, SHINGLE)
                sig = signatures(bag, w.rows)
                n = np.diff(bag.ptr) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.rows), pa.array(class_keys(w, bag), pa.binary()), pa.array([s.tobytes() if k else None for s, k in zip(sig, n)], pa.binary())],
                    ["doc_id", "class_key", "sig"],
                )

    return run


def _shared(members: DataFrame) -> DataFrame:
    """members (cid, bucket, …) of buckets of several, with their number ``n``."""
    counts = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(counts, "bucket")


def _band(k) -> F.Column:
    return F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS))


def buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, bucket, degree): members of all buckets of several, and of the parts of large ones by
    further bands; ``degree`` adds up the sizes of a member's buckets.  And (cid, band, bucket, n):
    members of the buckets alone, ``n`` in each."""
    signed = classes.where("sig is not null")
    bands = F.array(*[F.struct(F.lit(k).alias("band"), _band(k).alias("bucket")) for k in range(BANDS)])
    members = signed.select("cid", F.explode(bands).alias("x")).select("cid", "x.band", "x.bucket")
    hit = written(_shared(members), "buckets")
    large = hit.where(F.col("n") > SMALL_BUCKET).select("cid", "band", "bucket")
    hashes = signed.select("cid", F.array(*[_band(k) for k in range(BANDS)]).alias("hashes"))
    parts = F.array(*[F.xxhash64(F.lit(j), F.col("bucket"), F.element_at("hashes", ((F.col("band") + j) % BANDS + 1).cast("int"))) for j in range(1, FURTHER_BANDS + 1)])
    divided = _shared(large.join(hashes, "cid").select("cid", F.explode(parts).alias("bucket")))
    every = hit.select("cid", "bucket", "n").unionByName(divided.select("cid", "bucket", "n"))
    degrees = hit.groupBy("cid").agg(F.sum("n").alias("degree"))
    return written(every.join(degrees, "cid").select("cid", "bucket", "degree"), "members"), hit


def _meet(members: DataFrame, reps: DataFrame) -> DataFrame:
    return members.join(reps, "bucket").where("cid <> rep").select("cid", "rep")


def _central(members: DataFrame) -> DataFrame:
    return members.groupBy("bucket").agg(F.max(F.struct("degree", "cid")).alias("m")).select("bucket", F.col("m.cid").alias("rep"))


def first_pairs(members: DataFrame) -> DataFrame:
    """Every member with its bucket's most central member, that with the largest degree.  Rows grow
    with members, never with their pairs."""
    return _meet(members, _central(members)).distinct()


def divided(members: DataFrame, hit: DataFrame, joined: DataFrame) -> DataFrame:
    """(bucket, band, cid, component, main) of buckets that links haven't joined yet, without the
    central members, which have met all others; ``main`` marks a bucket's largest component."""
    rows = hit.where("n > 2").select("cid", "band", "bucket").join(_central(members), "bucket").where("cid <> rep").drop("rep")
    named = rows.join(joined.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    apart = sizes.groupBy("bucket").agg(F.count("*").alias("components"), F.max(F.struct("size", "component")).alias("m")).where("components > 1").select("bucket", F.col("m.component").alias("largest"))
    return named.join(apart, "bucket").select("bucket", "band", "cid", "component", (F.col("component") == F.col("largest")).alias("main"))


def _blocked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (bucket, …, main) dealt to groups (bucket, x, y), those of a group together; sizes
    (bucket, blocks, others).

    Members of the main component stay once, in block x = y >= 0, and all other members visit each
    of these blocks: the main component's members never meet each other, so a large family with
    some outliers costs rows in proportion.  The others meet among themselves in pairs of blocks of
    their own, x < 0."""
    dealt = rows.join(sizes, "bucket")
    own = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(F.col(n), F.lit(1).cast("bigint")))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    home = F.struct(own("blocks").alias("x"), own("blocks").alias("y"))
    visits = F.transform(upto("blocks"), lambda b: F.struct(b.alias("x"), b.alias("y")))
    among = F.transform(upto("others"), lambda b: F.struct((-1 - F.least(own("others"), b)).alias("x"), F.greatest(own("others"), b).alias("y")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("main"), F.array(home)).otherwise(F.concat(visits, among))))
    keys = ["bucket", "x", "y"]
    return dealt.select(*rows.columns, "at.x", "at.y").repartition(*keys).sortWithinPartitions(*keys, "component", "cid")


def _groups(batches):
    """Tables of the neighbouring rows with equal (bucket, x, y)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.names.index(c)).to_numpy() for c in ("bucket", "x", "y")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _near(sig: np.ndarray, t: pa.Table, estimate: float):
    """(i, js) of a group's members of different components that are estimated near and share no
    earlier band.  Members are sorted by component; visitors meet the main component only."""
    band, component = t.column("band")[0].as_py(), _column(t, "component")
    main = np.asarray(t.column("main"), bool)
    crossed = t.column("x")[0].as_py() >= 0
    ends = np.searchsorted(component, component, "right")
    left = np.flatnonzero(~main) if crossed else np.flatnonzero(ends < len(sig))
    rest = np.flatnonzero(main) if crossed else None
    at = 0
    while at < len(left):
        right = rest if crossed else np.arange(ends[left[at]], len(sig))
        if not len(right):
            return
        rows = left[at : at + max(1, STEP // (REGISTERS * len(right)))]
        if not crossed:
            rows = rows[ends[rows] == ends[rows[0]]]  # members of one component meet all behind it
        same = sig[rows][:, None, :] == sig[right][None, :, :]
        a, b = np.nonzero(same.sum(axis=2, dtype=np.int32) >= estimate * REGISTERS)
        agree = same[a, b, : BANDS * ROWS].reshape(len(a), BANDS, ROWS).all(axis=2)
        good = agree[:, band] & ~agree[:, :band].any(axis=1)
        a, b = a[good], b[good]
        for k in np.unique(a).tolist():
            yield int(rows[k]), right[b[a == k]]
        at += len(rows)


def _signed(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _candidates(estimate: float):
    """(bucket, cid) of members with a near one in their block that they haven't met."""

    def run(batches):
        for t in _groups(batches):
            if t.num_rows < 2:
                continue
            used = np.zeros(t.num_rows, bool)
            for i, js in _near(_signed(t), t, estimate):
                used[i] = used[js] = True
            if used.any():
                keep = pa.array(used)
                for batch in t.select(["bucket", "cid"]).filter(keep).combine_chunks().to_batches():
                    yield batch

    return run


def _joins(t: pa.Table, estimate: float):
    """(cid, rep) of links in a block that join what neither earlier links nor others here join."""
    component, cid = _column(t, "component"), _column(t, "cid")
    hashes = [np.frombuffer(x, _U) for x in t.column("hashes").to_pylist()]
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
    size = np.array([len(h) for h in hashes])
    start = np.cumsum(size) - size
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.add.reduceat(count, start)
    dense = np.zeros(len(known), np.int64)
    root = np.unique(component, return_inverse=True)[1]
    for i, js in _near(_signed(t), t, estimate):
        js = js[(root[js] != root[i]) & (np.minimum(total[js], total[i]) >= SIMILARITY * np.maximum(total[js], total[i]) - 1e-6)]
        if not len(js):
            continue
        own = slice(start[i], start[i] + size[i])
        dense[place[own]] = count[own]
        ends = np.cumsum(size[js])
        at = np.arange(ends[-1]) + np.repeat(start[js] - (ends - size[js]), size[js])
        both = np.add.reduceat(np.minimum(dense[place[at]], count[at]), ends - size[js])
        dense[place[own]] = 0
        for j in js[both / (total[js] + total[i] - both) >= SIMILARITY].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield int(cid[i]), int(cid[j])


def _rest(estimate: float):
    def run(batches):
        for t in _groups(batches):
            found = list(_joins(t, estimate)) if t.num_rows > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["cid", "rep"])

    return run


def rest_links(apart: DataFrame, classes: DataFrame, bags: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    """(cid, rep): links that join the components of all buckets as far as any pair in them does."""
    sig = classes.select("cid", "sig")
    per = lambda what, most, of: F.ceil(F.sum(F.when(of, what).otherwise(0)) / most).cast("bigint")
    main, one = F.col("main"), F.lit(1)
    dealt = _blocked(apart.join(sig, "cid"), apart.groupBy("bucket").agg(per(one, BLOCK, main).alias("blocks"), per(one, BLOCK, ~main).alias("others")))
    near = written(dealt.mapInArrow(_candidates(estimate), "bucket bigint, cid bigint").distinct(), "near")
    found = apart.join(near, ["bucket", "cid"])
    widths = [F.greatest(per(one, BLOCK, of), per(F.col("size"), BLOCK_SHINGLES, of)).alias(name) for name, of in (("blocks", main), ("others", ~main))]
    sizes = found.join(bags.select("cid", "size"), "cid").groupBy("bucket").agg(*widths)
    full = found.join(sig, "cid").join(bags.select("cid", "hashes", "counts"), "cid")
    return written(_blocked(full, sizes).mapInArrow(_rest(estimate), "cid bigint, rep bigint"), "rest")


def _estimated(estimate: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            keep = (a == b).mean(axis=1) >= estimate
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["cid", "rep"])

    return run


def _bags(batches):
    """The shingle multisets of the rows whose text has the class's key."""
    for batch in batches:
        cid, key = batch.column(0), batch.column(1).to_pylist()
        for w in tv.pieces(batch.column(2)):
            bag = tv.shingles(w, SHINGLE)
            ids, hashes, counts = [], [], []
            for i, k in enumerate(class_keys(w, bag)):
                if k == key[w.first + i]:
                    ids.append(cid[w.first + i].as_py())
                    hashes.append(bag.hash[bag.ptr[i] : bag.ptr[i + 1]].tobytes())
                    counts.append(bag.count[bag.ptr[i] : bag.ptr[i + 1]].astype(np.uint32).tobytes())
            size = [len(c) // 4 for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()), pa.array(size, pa.int64())], ["cid", "hashes", "counts", "size"])


def overlap(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given by sorted distinct hashes and counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(ca[i], cb[j]).sum(dtype=np.int64)
    whole = ca.sum(dtype=np.int64) + cb.sum(dtype=np.int64) - both
    return float(both / whole) if whole else 1.0


def _verify(batches):
    for batch in batches:
        keep = []
        for ha, ca, hb, cb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            keep.append(overlap(np.frombuffer(ha, _U), np.frombuffer(ca, np.uint32), np.frombuffer(hb, _U), np.frombuffer(cb, np.uint32)) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["cid", "rep"])


def _verified(pairs: DataFrame, classes: DataFrame, bags: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    sig = classes.select("cid", "sig")
    near = (
        pairs.join(sig.withColumnRenamed("sig", "sig_a"), "cid").join(sig.select(F.col("cid").alias("rep"), F.col("sig").alias("sig_b")), "rep")
        .select("cid", "rep", "sig_a", "sig_b").mapInArrow(_estimated(estimate), "cid bigint, rep bigint")
    )
    joined = near.join(bags.drop("size"), "cid").withColumnsRenamed({"hashes": "ha", "counts": "ca"}).join(bags.drop("size").withColumnRenamed("cid", "rep"), "rep")
    return written(joined.select("cid", "rep", "ha", "ca", "hashes", "counts").mapInArrow(_verify, "cid bigint, rep bigint"), "links")


def _keyed_bags(batches):
    """(class_key, hashes, counts, size) of texts, each key of a few megabytes of text once."""
    for batch in batches:
        for w in tv.pieces(batch.column(0)):
            bag = tv.shingles(w, SHINGLE)
            keys = class_keys(w, bag)
            first = {k: i for i, k in reversed(list(enumerate(keys)))}
            cut = [(k, bag.hash[bag.ptr[i] : bag.ptr[i + 1]].tobytes(), bag.count[bag.ptr[i] : bag.ptr[i + 1]].astype(np.uint32).tobytes(), int(bag.ptr[i + 1] - bag.ptr[i])) for k, i in first.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cut), (pa.binary(), pa.binary(), pa.binary(), pa.int64()))], ["class_key", "hashes", "counts", "size"])


def class_bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, hashes, counts, size) of the wanted classes (cid, class_key, want).

    A class whose id names no other class takes its text by an equi-join on the id.  Where classes
    have no id or share one, the texts of such ids are keyed again and meet their class by its key,
    each key of a task once: no text meets another class."""
    shared = wanted.groupBy("want").agg(F.count("*").alias("n")).where("n > 1 or want is null").select("want")
    one = wanted.join(shared, "want", "left_anti").where("want is not null")
    bags = docs.join(one, F.col("doc") == F.col("want")).select("cid", "class_key", "words").mapInArrow(_bags, "cid bigint, hashes binary, counts binary, size bigint").dropDuplicates(["cid"])
    if not shared.limit(1).count():
        return bags
    some = docs.where("doc is null").unionByName(docs.join(shared.where("want is not null"), F.col("doc") == F.col("want"), "left_semi"))
    keyed = some.select("words").mapInArrow(_keyed_bags, "class_key binary, hashes binary, counts binary, size bigint").dropDuplicates(["class_key"])
    more = wanted.join(one.select("cid"), "cid", "left_anti")
    return bags.unionByName(keyed.join(more.select("cid", "class_key"), "class_key").select("cid", "hashes", "counts", "size"))


def joined_classes(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text", estimate: float = ESTIMATE) -> DataFrame:
    """(node, component) of the classes of copies that verified links join."""
    members, hit = buckets(classes)
    wanted = members.select("cid").distinct().join(classes.select("cid", "class_key", "doc"), "cid").withColumnRenamed("doc", "want")
    bags = written(class_bags(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("words")), wanted), "shingles")
    links = _verified(first_pairs(members), classes, bags, estimate)
    found = written(components(links, "cid", "rep"), "joined")
    more = rest_links(written(divided(members, hit, found), "divided"), classes, bags, estimate)
    if not more.limit(1).count():
        return found
    return components(found.select(F.col("node").alias("cid"), F.col("component").alias("rep")).union(more), "cid", "rep")


def _named(rows: DataFrame, estimate: float) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text) with their class keys, and (class_key, copy_of, class_id, component, rows)."""
    with Scratch(rows.sparkSession) as scratch:
        signed = scratch.keep(written(rows.mapInArrow(_sign("text"), "doc_id bigint, class_key binary, sig binary"), "signatures"))
        classes = signed.groupBy("class_key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
        classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        joined = joined_classes(rows, classes, estimate=estimate).withColumnRenamed("node", "cid")
        named = classes.select("cid", "class_key", "doc", "rows").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        heads = named.groupBy("component").agg(F.min("doc").alias("class_id"))
        named = scratch.keep(written(named.join(heads, "component").select("class_key", F.col("doc").alias("copy_of"), "class_id", "component", "rows"), "named"))
    return signed, named


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", estimate: float = ESTIMATE) -> DataFrame:
    """(doc_id, class_id, copy_of) for each row of ``docs``.

    ``copy_of`` is the least id of the texts with equal shingle multisets, ``class_id`` the least
    id of all texts joined to it by links of weighted Jaccard similarity 0.8 or more.  Ids must be
    bigint.  A null text counts as empty; texts without words are copies only of texts of the same
    bytes (letter case aside) and have no links; a text of fewer than five words is one shingle.
    Repeated rows keep their rows.  A null id names a class only if the class has no other id.
    ``estimate`` is the likeness by signatures from which pairs are verified, 0 for all candidates.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed, named = _named(rows, estimate)
    return joined_on(signed.select("doc_id", "class_key"), named, "class_key", heavy_keys(named, "class_key", "rows")).select("doc_id", "class_id", "copy_of")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", estimate: float = ESTIMATE) -> DataFrame:
    """One row of each class stays, one with the class's least id; columns are those of ``docs``.

    Where ids are unique that is an equi-join on the id.  Where rows repeat an id, with equal or
    different texts, one of each class's rows with the least id stays.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed, named = _named(rows, estimate)
    repeated = signed.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        kept = named.select(F.col("class_id").alias("_kept"))
        return docs.join(kept, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_kept")), "left_semi")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = keyed.select("row", "doc_id", F.lit(b"").alias("class_key")).schema
    keyed = keyed.mapInArrow(_key_rows, schema)
    met = joined_on(keyed, named.drop("rows"), "class_key", heavy_keys(named, "class_key", "rows"))
    return met.where("doc_id <=> class_id").dropDuplicates(["component"]).select("row.*")


def _key_rows(batches):
    for batch in batches:
        keys = []
        for w in tv.pieces(batch.column(2)):
            keys += class_keys(w, tv.shingles(w, SHINGLE))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["row", "doc_id", "class_key"])
