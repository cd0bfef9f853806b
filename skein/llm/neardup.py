"""Near-duplicate documents: many universal hash minima, banding, signature verification, connected components.

A document's set holds its distinct ``shingle``-word runs in lower case (A-Z only); a shorter text is one run. Two
documents are linked if 100 * |both| >= percent * |either|.

Plan
1. One pass makes a 128-bit identity of each set and ``bands * rows`` minima of universal hashes. Documents with equal
   sets form a class (least doc_id represents it), so exact copies cost one row however many there are.
2. Classes that agree in a band meet in a bucket. A bucket first links every member to its least member (a star, never
   all pairs). Candidates pass if their signatures agree well enough and the full sets confirm the similarity.
3. Connected components by alternating large-star and small-star, of the confirmed links (components) and of the looser
   star candidates (families). A family whose members are all in one component is settled. In the others, members of
   different components are compared on full sets in blocks of bounded size, inside numpy; a block emits a spanning forest
   of its links, never all pairs.
4. Members of a bucket that lie in different families are compared by signature in such blocks too; the few pairs that pass
   are confirmed on full sets, and components are taken again. So no link that banding finds is lost, and no bucket or
   family is ever gathered into one task.

With 32 bands of 4 rows, a pair at similarity 0.85 shares no band with probability 6e-11, at 0.8 with 5e-8. Shingles are
64-bit hashes of word runs; set comparisons are exact but for hash collisions.

Defined cases: texts without words link with nothing and represent themselves; rows with a null doc_id get a null
component and are not kept; rows that share a doc_id are one node, linked with whatever one of its texts is linked with, and
all its rows agree in component and kept (n_shingles is each row's own); an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import connected_components
from skein.llm.textkernels import BASE_A, BASE_B, Words, mix, powers, rolling, slices
from skein.session import saved

BLOCK, BLOCK_SHINGLES = 256, 1 << 20
MOST_BROADCAST = 2_000_000
LOOSE = 0.5  # agreement with a bucket's hub that makes a family
SIGNATURE = "doc_id long, n_shingles long, set_hi long, set_lo long, sig binary"


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words = Words(texts, lower=True)
    runs = mix(rolling(words.ids, shingle, BASE_A))
    up, _ = powers(BASE_A, shingle)
    out = []
    for row in range(len(words)):
        a, b = int(words.first[row]), int(words.first[row + 1])
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            out.append(mix(np.array([(words.ids[a:b] * up[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(runs[:0])
    return out


def universal(n: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of n multiply-shift hashes."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(values: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mult), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(values), 512):
        part = values[at : at + 512]
        np.minimum(low, ((mult[:, None] * part[None, :] + add[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=low)
    return low


def _signatures(shingle: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = universal(n)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                sets = shingle_sets(texts.slice(lo, hi - lo), shingle)
                high = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                low = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(BASE_B))) if len(s) else 0 for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array([minima(s, mult, add).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "sig"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts.slice(lo, hi - lo), shingle)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else []))], ["doc_id", "shingles"])

    return run


def agreement(sig_a: pd.Series, sig_b: pd.Series) -> np.ndarray:
    """Share of equal minima of two columns of signatures."""
    if not len(sig_a):
        return np.empty(0)
    a = np.frombuffer(b"".join(sig_a), dtype=np.uint32).reshape(len(sig_a), -1)
    b = np.frombuffer(b"".join(sig_b), dtype=np.uint32).reshape(len(sig_b), -1)
    return (a == b).mean(axis=1)


def _agreeing(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["agreed"] = agreement(f["sig_a"], f["sig_b"])
            yield f.loc[f["agreed"] >= least, ["a", "b", "agreed"]]

    return run


def _cross(least: float):
    """Pairs (left, right) of one block of a bucket that lie in different groups and agree well enough."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        sides = (f[f["left"]], f[~f["left"]])
        (rep_l, own_l, sig_l), (rep_r, own_r, sig_r) = [(p["rep"].to_numpy(), p["own"].to_numpy(), np.frombuffer(b"".join(p["payload"]), dtype=np.uint32).reshape(len(p), -1)) for p in sides]
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in range(len(rep_l)):
            ys = np.flatnonzero(own_r != own_l[x])
            ys = ys[(sig_r[ys] == sig_l[x]).mean(axis=1) >= least]
            out_a.append(np.minimum(rep_r[ys], rep_l[x]))
            out_b.append(np.maximum(rep_r[ys], rep_l[x]))
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _forest(percent: int):
    """Links (left, right) of one block of a family on full sets, only those that join what is not yet joined."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = (f[f["left"]], f[~f["left"]])
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = right["payload"].map(len).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vocabulary, codes = np.unique(np.concatenate(right["payload"].tolist()), return_inverse=True)
            rep_r = right["rep"].to_numpy()
            group = right["own"].to_numpy().copy()  # of each right member, as links merge groups
            merged: dict[int, int] = {}
            held = np.zeros(len(vocabulary), dtype=np.int64)
            for rep, own, values in zip(left["rep"], left["own"], left["payload"]):
                while own in merged:
                    own = merged[own]
                if (group == own).all():
                    continue
                at = np.searchsorted(vocabulary, values)
                at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == values)]
                held[at] = 1
                common = np.add.reduceat(held[codes], starts)
                held[at] = 0
                for y in np.flatnonzero(100 * common >= percent * (sizes + len(values) - common)):
                    if group[y] != own:
                        out.append((min(rep, rep_r[y]), max(rep, rep_r[y])))
                        merged[group[y]] = own
                        group[group == group[y]] = own
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def among(df: DataFrame, key: str, wanted: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows of ``df`` whose key is one of the single column of ``wanted``.

    The keys alone are broadcast where they are counted to be at most ``most`` (8 bytes each), so that wide rows nobody
    wants are not shuffled; beyond it both sides are shuffled.
    """
    keys = saved(wanted.toDF(key).distinct(), "wanted")
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, key, "left_semi")


class NearDuplicates:
    """The stages over one table of documents; ``labelled`` is the result."""

    def __init__(self, docs: DataFrame, percent: int = 85, shingle: int = 5, bands: int = 32, rows: int = 4, margin: float = 0.2):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.percent, self.shingle, self.bands, self.rows = percent, shingle, bands, rows
        # 128 minima estimate 0.85 with a deviation of 0.03, so the margin is over six of these
        self.least = percent / 100 - margin
        self.signed = saved(self.docs.mapInArrow(_signatures(shingle, bands * rows), SIGNATURE), "signatures")
        self.classes = saved(
            self.signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hi", "set_lo", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("least"))
            .select("set_hi", "set_lo", "n_shingles", F.col("least.doc_id").alias("rep"), F.col("least.sig").alias("sig")),
            "classes",
        )

    def banded(self) -> DataFrame:
        width = 4 * self.rows
        band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width)))))
        return self.classes.select("rep", band.alias("bucket"))

    def likely(self, pairs: DataFrame, sig: DataFrame, least: float) -> DataFrame:
        """Those candidate pairs whose signatures (rep, sig) agree: a, b, agreed."""
        met = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        return saved(met.mapInPandas(_agreeing(least), "a long, b long, agreed double"), "likely")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets of the wanted documents (doc_id): doc_id, shingles."""
        return among(self.docs, "doc_id", wanted).mapInArrow(_sets(self.shingle), "doc_id long, shingles array<long>")

    def confirmed(self, likely: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose full sets are similar enough."""
        sets = saved(self.sets(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id")))), "sets")
        both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        sized = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
        return sized.filter(100 * F.col("common") >= self.percent * (F.col("total") - F.col("common"))).select("a", "b").distinct()

    def blocks(self, members: DataFrame, payload, compare) -> DataFrame:
        """Pairs across the groups of each ``place``, from members (place, rep, own, hub_own).

        Members outside their hub's group (left) meet all members of the place (right), in blocks of about BLOCK by BLOCK
        and BLOCK_SHINGLES a side; what the hub's group holds is not compared with itself. Places of one group are settled.
        ``payload`` gives (rep, payload) for rows of (rep); ``compare`` makes pairs of a block.
        """
        outside = F.col("own") != F.col("hub_own")
        members = members.join(self.classes.select("rep", "n_shingles"), "rep")
        heavy = lambda c: F.sum(F.when(c, F.col("n_shingles")).otherwise(0))
        sizes = members.groupBy("place").agg(F.count(F.when(outside, 1)).alias("n_left"), F.count(F.lit(1)).alias("n_all"), heavy(outside).alias("s_left"), heavy(F.lit(True)).alias("s_all")).filter("n_left > 0 and n_all > 2")
        grid = lambda side: F.greatest(F.ceil(F.col(f"n_{side}") / BLOCK), F.ceil(F.col(f"s_{side}") / BLOCK_SHINGLES)).cast("int")
        rows = saved(members.join(sizes, "place").withColumns({"grid_l": grid("left"), "grid_r": grid("all")}), "unsettled")
        own = lambda grid: F.pmod(F.xxhash64("rep"), F.col(grid)).cast("int")
        others = lambda grid: F.explode(F.sequence(F.lit(0), F.col(grid) - 1))
        left = rows.filter(outside).select("place", "rep", "own", own("grid_l").alias("i"), others("grid_r").alias("j"), F.lit(True).alias("left"))
        right = rows.select("place", "rep", "own", others("grid_l").alias("i"), own("grid_r").alias("j"), F.lit(False).alias("left"))
        dealt = left.unionByName(right).join(payload(rows.select("rep")), "rep")
        return dealt.groupBy("place", "i", "j").applyInPandas(compare, "a long, b long").distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b) that span the components, and the component of every representative that has a link (node, component)."""
        banded = self.banded()
        hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1").select("bucket", "hub")
        met = saved(banded.join(hubs, "bucket"), "met")
        sig = saved(among(self.classes.select("rep", "sig"), "rep", met.select("rep")), "sig")
        near = self.likely(met.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), sig, min(LOOSE, self.least))
        stars = saved(self.confirmed(near.filter(F.col("agreed") >= self.least)), "stars")
        found, families = connected_components(stars), saved(connected_components(near), "families")

        member = families.select(F.col("component").alias("place"), F.col("node").alias("rep"))
        member = member.join(found.select(F.col("node").alias("rep"), F.col("component").alias("own")), "rep", "left").withColumn("own", F.coalesce("own", "rep"))
        # a family's least member is its hub, and the least of its component too
        within = self.blocks(member.withColumn("hub_own", F.col("place")), lambda reps: self.sets(reps.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), F.col("shingles").alias("payload")), _forest(self.percent))

        of = lambda node, name: families.select(F.col("node").alias(node), F.col("component").alias(name))
        apart = met.join(of("rep", "own"), "rep", "left").join(of("hub", "hub_own"), "hub", "left")
        apart = apart.select(F.col("bucket").alias("place"), "rep", F.coalesce("own", "rep").alias("own"), F.coalesce("hub_own", "hub").alias("hub_own"))
        across = self.blocks(apart, lambda _: sig.withColumnRenamed("sig", "payload"), _cross(self.least))
        links = saved(stars.unionByName(within).unionByName(self.confirmed(saved(across, "across"))).unionByName(self.shared_ids()), "links")
        return links, connected_components(links)

    def shared_ids(self) -> DataFrame:
        """Links (a, b) between the classes of texts that share a doc_id."""
        worded = self.signed.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_hi", "set_lo", "n_shingles").distinct()
        repeated = worded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
        reps = worded.join(repeated, "doc_id", "left_semi").join(self.classes.drop("sig"), ["set_hi", "set_lo", "n_shingles"]).select("doc_id", "rep")
        least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
        return reps.join(least, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()

    def labelled(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row."""
        _, found = self.links()
        reps = self.classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hi", "set_lo", "n_shingles", F.coalesce("component", "rep").alias("class_component"))
        rows = saved(self.signed.select("doc_id", "n_shingles", "set_hi", "set_lo").join(reps, ["set_hi", "set_lo", "n_shingles"], "left").select("doc_id", "n_shingles", "class_component"), "labelled")
        # a row without words takes the component of another text of its doc_id, if there is one
        blank = rows.filter("n_shingles = 0").select("doc_id", "n_shingles")
        other = rows.filter("n_shingles > 0").join(blank.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "class_component").distinct()
        every = rows.filter("n_shingles > 0").unionByName(blank.join(other, "doc_id", "left"))
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
        return every.select("doc_id", "n_shingles", component.alias("component_id"), (F.coalesce(component == F.col("doc_id"), F.lit(False))).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    return NearDuplicates(docs, percent, **options).labelled()


def keep_one(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """Rows of ``docs``, one of each group: the least doc_id. Of its repeated rows the one of least hash stays; rows with a null doc_id stay."""
    kept = near_duplicates(docs, percent, **options).filter("kept").select("doc_id").distinct()
    # the row is nested, so that no column of it can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*(docs[c] for c in docs.columns)).alias("hash"), F.struct(*docs.columns).alias("row"))
    one = rows.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "hash").alias("row"))
    every = one.select("row").unionByName(rows.filter("doc_id is null").select("row"))
    return every.select(*(F.col("row")[c].alias(c) for c in docs.columns))
