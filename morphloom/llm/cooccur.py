"""Items that appear together (problem 5): an incremental table of pair counts.

State is one table of signed counts with three kinds of rows. (a, b, null, null,
n): n baskets hold the items with codes a and b. (a, null, space, item, n): n
baskets of the space (a language pair, say) hold the item, whose code is a.
(null, null, space, null, n): the space has n baskets. An item's code is a 64-bit
hash of space and item, so that the many pair rows stay narrow; that no two items
share a code is verified on every merge, over the items of all buckets.

A change of a basket becomes signed rows of the same form, merges into the
buckets it touches by addition, and marks the pairs whose association it affects:
those whose own count or one of whose items' counts changed. Only those are
scored again. The number of baskets of a space, which every association of the
space depends on, is not stored with the scores but joined when they are read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphloom.session import scratch

KEY = ("a", "b", "space", "item")
SCHEMA = "a bigint, b bigint, space string, item string, n bigint"
SCORES = "a bigint, b bigint, space string, word_a string, word_b string, n_ab bigint, n_a bigint, n_b bigint"
#: Bytes of input for which a table gets one hash bucket, and the least and greatest number of buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 16, 8192
#: Hit buckets that one job merges.
AT_ONCE = 64
#: Items of a block; a basket of more than two blocks' items is cut into blocks, whose pairs of blocks are tasks' units.
BLOCK = 1000
#: Sides of a basket that hold an item, as bits: the content before, the content after.
BEFORE, AFTER = 1, 2
SEPARATOR, ESCAPE = "\u001f", "\u001b"


def packed(*columns: Column) -> Column:
    """Text columns as one text, exactly; nulls stay nulls. One text takes less room in an exchange than several."""
    safe = [F.coalesce(F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(SEPARATOR), F.lit(ESCAPE + "s")), F.lit(ESCAPE + "n")) for c in columns]
    return F.concat_ws(SEPARATOR, *safe)


def _unescaped(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit(ESCAPE + "s"), F.lit(SEPARATOR)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))
    return F.when(~F.contains(text, F.lit(ESCAPE)), text).when(text != ESCAPE + "n", plain)


def unpacked(text: Column, names: list[str]) -> list[Column]:
    """The columns that ``packed`` made one text of."""
    parts = F.split(text, SEPARATOR)
    return [_unescaped(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]


def _listed(items: Column) -> Column:
    """A set of items as one text; the empty set has a text of its own."""
    return F.when(F.size(items) == 0, ESCAPE + "z").otherwise(F.array_join(items, SEPARATOR))


def _items_of(text: Column) -> Column:
    return F.when(text == ESCAPE + "z", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, SEPARATOR), _unescaped))


def pieces_of(
    df: DataFrame, space: str, basket: list[str], item: str, sides: str | None = None, within: str | None = None, near: str | None = None, hot: dict | None = None, block: int = BLOCK
) -> DataFrame:
    """(space, basket columns, i, j, sides, items): the distinct items of each basket, as (item, bits, block) in ascending order.

    A basket is one piece (i = j = 0) unless it has more than two blocks' items:
    then each of its items belongs to one of k blocks by hash, and there is a
    piece for each pair of blocks i <= j, so no row and no task ever holds such a
    basket. Rows with a null item are ignored; null is a basket value like any
    other. Items that a basket holds repeatedly count once.

    sides: a column of bits that says whether a row belongs to the basket's
    content before (1), after (2) or both (None: after). Column ``sides`` has the
    bits of the whole basket.
    within: a column the rows are partitioned by already; the parts of baskets
    that lie together are joined before they travel. near: a basket column whose
    values tend to repeat pairs. Baskets with one value of it then meet in one
    task, which counts their common pairs once; ``hot`` gives for values that
    hold very many rows the number of tasks they are spread over.
    """
    bits = F.lit(AFTER) if sides is None else F.col(sides)
    lying = F.spark_partition_id() if within is None else F.col(within)
    named = df.filter(F.col(item).isNotNull()).select(F.col(space).alias("space"), *basket, packed(F.col(item)).alias("__item"), bits.alias("__bits"), lying.alias("__within"))
    key = ["space", *basket]
    side = lambda bit: F.array_sort(F.collect_set(F.when(F.col("__bits").bitwiseAND(bit) > 0, F.col("__item"))))
    sets = named.groupBy("__within", *key).agg(_listed(side(BEFORE)).alias("before"), _listed(side(AFTER)).alias("after"))
    sets = sets.select(*key, "before", F.nullif("after", "before").alias("after"))
    together = key
    if near:
        tasks = F.lit(1) if not hot else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col(near)), F.lit(1))
        sets = sets.withColumn("__part", F.pmod(F.xxhash64(*basket), tasks).cast("int")).repartition("space", near, "__part")
        together = [*key, "__part"]
    else:
        sets = sets.repartition(*key)
    # parts of one basket lie in one partition now; how many items they list bounds the basket's size
    listed = lambda c: F.length(c) - F.length(F.replace(c, F.lit(SEPARATOR), F.lit(""))) + 1
    sized = sets.withColumn("__size", F.sum(listed(F.col("before")) + F.coalesce(listed(F.col("after")), F.lit(0))).over(Window.partitionBy(*together)))
    return _whole(sized.filter(F.col("__size") <= 2 * block), key, together).unionByName(_blocks(sized.filter(F.col("__size") > 2 * block), key, block))


PIECE = "array<struct<item string, bits int, block int>>"


def _whole(sets: DataFrame, key: list[str], together: list[str]) -> DataFrame:
    """Baskets of moderate size, one piece each."""
    merged = sets.groupBy(*together).agg(F.collect_list("before").alias("b"), F.collect_list(F.coalesce("after", "before")).alias("a"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, _items_of))))
    one = merged.select(*key, flat(F.col("b")).alias("b"), flat(F.col("a")).alias("a"))
    changed = F.transform(
        F.array_sort(F.array_union("b", "a")), lambda x: F.struct(x.alias("item"), (F.array_contains("b", x).cast("int") + 2 * F.array_contains("a", x).cast("int")).alias("bits"), F.lit(0).alias("block"))
    )
    same = F.transform("a", lambda x: F.struct(x.alias("item"), F.lit(3).alias("bits"), F.lit(0).alias("block")))
    held = F.when(F.size("b") > 0, BEFORE).otherwise(0) + F.when(F.size("a") > 0, AFTER).otherwise(0)
    return one.select(*key, F.lit(0).alias("i"), F.lit(0).alias("j"), held.alias("sides"), F.when(F.col("a") == F.col("b"), same).otherwise(changed).cast(PIECE).alias("items"))


def _blocks(sets: DataFrame, key: list[str], block: int) -> DataFrame:
    """Baskets of very many items: a piece for each pair of blocks. The basket's own row is a piece (-1, -1) without items."""
    sides = [(BEFORE, F.col("before")), (AFTER, F.coalesce("after", "before"))]
    rows = sets.select(*key, "__size", F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), text.alias("text")) for bit, text in sides])).alias("s"))
    rows = rows.select(*key, "__size", "s.bit", F.explode(_items_of(F.col("s.text"))).alias("item")).groupBy(*key, "__size", "item").agg(F.bit_or("bit").alias("bits"))
    blocks = F.ceil(F.col("__size") / block).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("item"), blocks).cast("int")).withColumn("k", blocks)
    met = own.select(*key, "item", "bits", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    met = met.groupBy(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.array_sort(F.collect_list(F.struct("item", "bits", "block"))).cast(PIECE).alias("items"))
    heads = rows.groupBy(*key).agg(F.bit_or("bits").alias("sides")).select(*key, F.lit(-1).alias("i"), F.lit(-1).alias("j"), "sides", F.array().cast(PIECE).alias("items"))
    return met.select(*key, "i", "j", F.lit(0).alias("sides"), "items").unionByName(heads)


def pair_rows(pieces: DataFrame, seed: int = 0) -> DataFrame:
    """(key, base, change): what the baskets' content before adds to the state, and what their change adds to that, summed by key.

    Pairs are made one after the other while they are counted; no list of them is
    kept. Rows of which neither is anything are left out.
    """
    code = lambda x: F.xxhash64(F.lit(seed), F.col("space"), x)
    nobody = F.struct(F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("string").alias("item"), F.col("sides").alias("bits"), F.lit(0).alias("block"))
    coded = pieces.select("space", "i", "j", "sides", F.transform("items", lambda x: F.struct(code(x["item"]).alias("code"), x["item"].alias("item"), x["bits"].alias("bits"), x["block"].alias("block"))).alias("items"))
    # what an item is to its partners, made once for each basket; the partners of a place are a slice of it
    slim = coded.withColumn("slim", F.transform("items", lambda x: F.struct(x["code"].alias("code"), x["bits"].alias("bits"), x["block"].alias("block"))))
    # place 0 stands for the basket itself; an item's partners are nobody (its own row) and the items after it
    firsts = slim.select("space", "i", "j", "slim", "sides", F.posexplode(F.concat(F.array(nobody), "items")).alias("at", "x"))
    alone = F.array(F.struct(F.lit(None).cast("bigint").alias("code"), F.col("x.bits").alias("bits"), F.lit(-1).alias("block")))
    later = F.slice("slim", F.col("at") + 1, F.size("slim"))
    own = (F.col("at") > 0) & (F.col("i") == F.col("j")) | (F.col("at") == 0) & (F.col("sides") > 0)
    partners = F.when(F.col("at") == 0, F.when(own, alone)).when(own, F.concat(alone, later)).otherwise(later)
    rows = firsts.select("space", "i", "j", "x", F.explode(partners).alias("y")).filter((F.col("i") == F.col("j")) | (F.col("y.block") < 0) | (F.col("x.block") != F.col("y.block")))
    bits, single = F.col("x.bits").bitwiseAND(F.col("y.bits")), F.col("y.code").isNull()
    old, new = bits.bitwiseAND(BEFORE), F.shiftright(bits, 1)
    rows = rows.select(
        F.col("x.code").alias("a"), F.col("y.code").alias("b"), F.when(single, F.col("space")).alias("space"), F.when(single, F.col("x.item")).alias("item"),
        old.cast("bigint").alias("base"), (new - old).cast("bigint").alias("change"),
    ).filter("base <> 0 or change <> 0")
    return rows.groupBy(*KEY).agg(F.sum("base").alias("base"), F.sum("change").alias("change")).filter("base <> 0 or change <> 0")


def loaded(rows: DataFrame) -> DataFrame:
    """(key, n): the rows of ``pair_rows`` as a first load of the contents before."""
    return rows.select(*KEY, F.col("base").alias("n")).filter("n <> 0")


def changed(rows: DataFrame) -> DataFrame:
    """(key, n): the rows of ``pair_rows`` as signed deltas; an unchanged basket has none."""
    return rows.select(*KEY, F.col("change").alias("n")).filter("n <> 0")


def merge(*parts: DataFrame) -> DataFrame:
    """The sum of signed rows; keys whose count returns to 0 are dropped."""
    union = reduce(DataFrame.unionByName, [p.select(*KEY, "n") for p in parts])
    return union.groupBy(*KEY).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def scored(state: DataFrame, least: int, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, space, word_a, word_b, n_ab, n_a, n_b): pairs that at least ``least`` baskets hold, with their items and those items' counts."""
    pairs = state.filter(F.col("b").isNotNull() & (F.col("n") >= least)) if pairs is None else pairs
    single = state.filter(F.col("a").isNotNull() & F.col("b").isNull() & (F.col("n") >= least))
    n_a = single.select("a", "space", F.col("item").alias("word_a"), F.col("n").alias("n_a"))
    n_b = single.select(F.col("a").alias("b"), F.col("item").alias("word_b"), F.col("n").alias("n_b"))
    return pairs.select("a", "b", F.col("n").alias("n_ab")).join(n_a, "a").join(n_b, "b").select("a", "b", "space", "word_a", "word_b", "n_ab", "n_a", "n_b")


def associations(state: DataFrame, least: int = 1, lift: int = 0, scores: DataFrame | None = None) -> DataFrame:
    """(space, word_a, word_b, n_ab, n_a, n_b, baskets): the pairs of the state with their marginals.

    least: baskets that hold both, at least. lift: n_ab x baskets is at least
    this many times n_a x n_b. The products are made in decimals, so they cannot
    overflow. scores: what ``scored`` made of the state already.
    """
    total = state.filter(F.col("a").isNull()).select(F.col("space").alias("s0"), F.col("n").alias("baskets"))
    pairs = scored(state, least) if scores is None else scores.filter(F.col("n_ab") >= least)
    joined = pairs.join(total, F.col("space").eqNullSafe(F.col("s0")))
    times = lambda x, y: x.cast("decimal(19, 0)") * y.cast("decimal(19, 0)")
    far = times(F.col("n_ab"), F.col("baskets")) >= times(F.col("n_a") * F.lit(lift), F.col("n_b"))
    return joined.filter(far).select("space", "word_a", "word_b", "n_ab", "n_a", "n_b", "baskets")


def buckets_for(size: int, unit: int) -> int:
    """Hash buckets for a table over ``size`` bytes of input: a multiple of ``unit``, the partitions of an exchange, so that a task writes whole buckets."""
    wanted = min(max(size // BUCKET_BYTES, LEAST_BUCKETS), MOST_BUCKETS)
    return max(1, -(-wanted // unit)) * unit


class PairTable:
    """The persistent counts and scores: Parquet folders, one for each hash bucket of the key, and a manifest that names the current ones.

    ``apply`` adds deltas: only buckets that hold a changed key are read, merged
    and written again, each by one task and without an exchange of what it holds,
    as a new generation. The manifest is written last and renamed into place, so a
    failed merge leaves the table as it was; folders that it no longer names are
    removed then. A table in an existing folder is opened as its manifest says.
    The driver holds one number for each bucket.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = LEAST_BUCKETS, least: int = 1) -> None:
        self.spark, self.folder = spark, (folder or scratch(spark, "pairs")).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        names = [n for n in self._names(self.folder) if n.startswith("manifest-") and n.endswith(".json")]
        self.manifest: dict = {"generation": 0, "buckets": buckets, "least": least, "newest": {}, "scores": None, "pending": []}
        if names:
            self.manifest = json.loads("".join(r[0] for r in spark.read.text(f"{self.folder}/{max(names)}").collect()))

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    def bucket(self) -> Column:
        """The bucket of a row. The hash is the one that exchanges use, so partitions whose number divides the buckets' hold whole buckets."""
        return F.pmod(F.hash(*KEY), F.lit(self.manifest["buckets"])).cast("int")

    def state(self) -> DataFrame:
        """(a, b, space, item, n) of all buckets."""
        paths = [f"{self.folder}/{name}" for name in sorted(self.manifest["newest"].values())]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def apply(self, deltas: DataFrame) -> "PairTable":
        """Merge signed rows (key, n), unique by key, into the table."""
        made = f"generation-{self.generation + 1:08}"
        rows = deltas.select(*KEY, "n", self.bucket().alias("bucket"))
        delta = f"{made}/delta"
        rows.sortWithinPartitions("bucket", "a", "b").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{delta}")
        newest = dict(self.manifest["newest"])
        hit = [n for n in self._names(f"{self.folder}/{delta}") if n.startswith("bucket=")]
        known = [b for b in hit if b in newest]
        for at in range(0, len(known), AT_ONCE):
            some = known[at : at + AT_ONCE]
            self._merge(some, {b: [f"{self.folder}/{newest[b]}", f"{self.folder}/{delta}/{b}"] for b in some}, f"{self.folder}/{made}/merged")
        written = set(self._names(f"{self.folder}/{made}/merged")) if known else set()
        for b in hit:
            if b not in known:
                newest[b] = f"{delta}/{b}"
            elif b in written:
                newest[b] = f"{made}/merged/{b}"
            else:
                del newest[b]
        self._verify(list(newest.values()))
        self._commit({**self.manifest, "generation": self.generation + 1, "newest": newest, "pending": [*self.manifest["pending"], delta] if self.manifest["scores"] else []})
        return self

    def _merge(self, buckets: list[str], paths: dict[str, list[str]], target: str) -> None:
        """Each bucket's state and delta summed in one task: a bucket's files are one partition, which needs no exchange to be grouped."""
        merged = [
            self.spark.read.schema(SCHEMA).parquet(*paths[b]).coalesce(1).groupBy(*KEY).agg(F.sum("n").alias("n")).filter("n <> 0").sortWithinPartitions("a", "b").withColumn("bucket", F.lit(int(b[7:])))
            for b in buckets
        ]
        # tables of one partition each would be united into one partition; a part without rows that has two keeps them apart
        none = self.spark.range(0, 2, 1, 2).filter("id < 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in merged[0].schema])
        reduce(DataFrame.unionByName, merged, none).write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(target)

    def scores(self) -> DataFrame:
        """The pairs that at least ``least`` baskets hold, with their counts: those that changes affected since are counted again, others stay."""
        least, old = self.manifest["least"], self.manifest["scores"]
        if old is None or self.manifest["pending"]:
            name = f"generation-{self.generation:08}/scores"
            fresh = scored(self.state(), least) if old is None else self._rescored(self.spark.read.schema(SCORES).parquet(f"{self.folder}/{old}"), least)
            fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
            self._commit({**self.manifest, "scores": name, "pending": []})
        return self.spark.read.schema(SCORES).parquet(f"{self.folder}/{self.manifest['scores']}")

    def _rescored(self, old: DataFrame, least: int) -> DataFrame:
        touched = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{p}" for p in self.manifest["pending"]]).filter(F.col("a").isNotNull())
        items = touched.filter(F.col("b").isNull()).select("a").distinct()
        both = touched.filter(F.col("b").isNotNull()).select("a", "b").distinct()

        def marked(pairs: DataFrame) -> DataFrame:
            one = pairs.join(items.withColumn("__a", F.lit(True)), "a", "left").join(items.select(F.col("a").alias("b"), F.lit(True).alias("__b")), "b", "left")
            return one.join(both.withColumn("__p", F.lit(True)), ["a", "b"], "left").withColumn("__hit", F.coalesce("__a", "__b", "__p", F.lit(False)))

        state = self.state()
        again = marked(state.filter(F.col("b").isNotNull() & (F.col("n") >= least)).select("a", "b", "n")).filter("__hit")
        return marked(old).filter("not __hit").select(*old.columns).unionByName(scored(state, least, again))

    def associations(self, lift: int = 0) -> DataFrame:
        """The scored pairs whose association is at least ``lift``."""
        scores = self.scores()
        return associations(self.state(), self.manifest["least"], lift, scores)

    def _verify(self, names: list[str]) -> None:
        """Raise if two items of the table have one code; deltas with another seed then have to be made."""
        if names:
            items = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in names]).filter("b is null and a is not null")
            if items.groupBy("a").count().filter("count > 1").limit(1).count():
                raise ValueError("two items share a code: make the deltas with another seed")

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commit(self, manifest: dict) -> None:
        """Write the manifest beside its name and rename it; then remove folders and manifests that it does not name."""
        number = max([int(n[9:17]) for n in self._names(self.folder) if n.startswith("manifest-")], default=0)
        final, draft = self._path(f"{self.folder}/manifest-{number + 1:08}.json"), self._path(f"{self.folder}/.draft-{number + 1:08}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"another writer has committed to {self.folder}")
        self.manifest = manifest
        used = {*manifest["newest"].values(), *manifest["pending"], *([manifest["scores"]] if manifest["scores"] else []), final.getName()}
        above = {u.rsplit("/", k)[0] for u in used for k in range(1, u.count("/") + 1)}
        for name in self._names(self.folder):
            if name.startswith(("generation-", "manifest-")):
                self._prune(name, used, above)

    def _prune(self, name: str, used: set[str], above: set[str]) -> None:
        """Remove what stands at ``name`` but for what is used."""
        if name in above:
            for part in self._names(f"{self.folder}/{name}"):
                self._prune(f"{name}/{part}", used, above)
        elif name not in used:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
