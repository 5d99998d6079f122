"""Lexical translation probabilities by expectation maximisation over chunks of target words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.session import materialise

#: Source words met by the target words of a chunk, about; a target word that meets more is cut into pieces by its rows.
MET = 1 << 21
#: Rows of a result's batch, and chunks a task is given.
BATCH, CHUNKS_A_TASK = 1 << 16, 8
#: Spark's setting to remove an execution's shuffle files at its end.
REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHUNK = "chunk bigint, spaces array<string>, targets array<string>, needs array<struct<id:int,target:string>>, body binary"


def em_table(source: DataFrame, target: DataFrame, rounds: int = 5, keep: float = 1e-6) -> DataFrame:
    """(space, target, source, prob): lexical translation probabilities by expectation maximisation (the first IBM model).

    source, target: (space, row, at, word). Starts uniform over co-occurring
    words. Each round spreads every target token over its row's source tokens by
    the current probabilities and normalises by source word; entries below
    ``keep`` go. A null word is none.

    What a target token spreads concerns its target word alone; only the sums of
    the source words need other targets. So rows are laid out once in chunks of
    whole target words, and a round leaves nothing but one sum for each source
    word: a chunk makes its probabilities again from the sums of all rounds
    before. The pieces of a target word that is cut get its probabilities
    instead, which are kept for such words only. Sums are written to the shared
    folder every round; a lost executor costs one round at most.
    """
    rows, words = _rows(source, target)
    chunks = _written(_chunks(rows), "em-chunks")
    some_cut = chunks.filter("chunk < 0").limit(1).count() > 0
    past, sums = words.select("id", "space", "source", F.array().cast("array<double>").alias("sums")), None
    for n in range(rounds + 1):
        met = chunks.select("chunk", "needs", "body", F.lit(None).cast("array<array<double>>").alias("known")) if sums is None else _told(chunks.select("chunk", "needs", "body"), past, sums, some_cut, keep)
        spread = met.mapInArrow(_spread(keep), "id int, target string, c double").groupBy("id", "target").agg(F.sum("c").alias("c"))
        if n == 0:  # every pair counts once, in how many pieces of a target word it may be
            spread = spread.withColumn("c", F.when(F.col("target").isNull(), F.col("c")).otherwise(F.lit(1.0)))
        sums = _written(spread, "em-sums")
        total = sums.groupBy("id").agg(F.sum("c").alias("c"))
        past = _written(past.join(total, "id").select("id", "space", "source", F.concat("sums", F.array("c")).alias("sums")), "em")
        whole = _told(chunks.filter("chunk >= 0"), past, sums, False, keep, "source").mapInArrow(_table(keep), "space string, target string, source string, prob double")
    if not some_cut:
        return whole
    return whole.unionByName(_probable(past, sums, keep).filter("prob > 0").select("space", "target", "source", "prob"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` whose shuffle files go as soon as it is done; else they would stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(REMOVE, None)
    conf.set(REMOVE, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(REMOVE) if before is None else conf.set(REMOVE, before)


def _rows(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(space, row, ids, counts, targets): rows with words on both sides; (id, space, source): the numbers of source words."""
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = lambda df: df.select("space", "row", "word").dropna().groupBy("space", "row", "word").agg(F.count(F.lit(1)).cast("int").alias("n"))
    s = _written(counted(source), "em-source")
    t = _written(counted(target).groupBy("space", "row").agg(F.collect_list(F.struct("word", "n")).alias("targets")), "em-target")
    number = F.monotonically_increasing_id()  # a partition's own count, under its number
    dense = (number.bitwiseAND((1 << 33) - 1) * tasks + F.shiftrightunsigned(number, 33)).cast("int")
    words = _written(s.select("space", "word").repartition(tasks, "space", "word").distinct().select(dense.alias("id"), "space", F.col("word").alias("source")), "em-words")
    one = s.join(words.select("id", "space", F.col("source").alias("word")), ["space", "word"]).groupBy("space", "row").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("s"))
    rows = _written(one.join(t, ["space", "row"]).select("space", "row", F.col("s.id").alias("ids"), F.col("s.n").alias("counts"), "targets"), "em-rows")
    return rows, words


def _chunks(rows: DataFrame) -> DataFrame:
    """CHUNK: the tokens of whole target words, or under a negative number those of pieces of target words."""
    sizes = _written(rows.groupBy("space").agg(F.sum(F.size("ids").cast("bigint") * F.size("targets")).alias("met")), "em-sizes")
    chunks = max(1, -(-(sizes.agg(F.sum("met")).first()[0] or 0) // MET))
    parts = lambda df: df.filter(F.col("met") > MET).withColumn("met", F.ceil(F.col("met") / MET))
    each = rows.select("space", "row", "ids", "counts", F.explode("targets").alias("t")).select("space", "row", F.col("t.word").alias("target"), F.col("t.n").alias("n"), "ids", "counts")
    pieces = _written(parts(each.groupBy("space", "target").agg(F.sum(F.size("ids").cast("bigint")).alias("met"))).withColumnRenamed("met", "pieces"), "em-cut")
    # a chunk has few spaces, so that it needs the sums of few source words: one of a large space, or some small ones
    number = lambda *of: F.xxhash64(*of).bitwiseAND((1 << 63) - 1)
    large, small = number("space", F.pmod(F.xxhash64("target"), F.col("parts"))), number(F.pmod(F.xxhash64("space"), F.lit(chunks)))
    each = each.join(parts(sizes).withColumnRenamed("met", "parts"), "space", "left").withColumn("chunk", F.when(F.col("parts").isNull(), small).otherwise(large))
    if pieces.limit(1).count():
        cut = -1 - number("space", "target", F.pmod(F.xxhash64("row"), F.col("pieces")))
        each = each.join(pieces, ["space", "target"], "left").withColumn("chunk", F.when(F.col("pieces").isNull(), F.col("chunk")).otherwise(cut))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks // CHUNKS_A_TASK))
    return each.select("chunk", "space", "target", "n", "ids", "counts").repartition(tasks, "chunk").groupBy("chunk").applyInArrow(_chunk, CHUNK)


def _chunk(rows: pa.Table) -> pa.Table:
    """One chunk's tokens as arrays: its pairs by target and source word, and for each target token the places of its pairs."""
    rows = rows.sort_by([("space", "ascending"), ("target", "ascending")]).combine_chunks()
    space, target = (rows[c].combine_chunks() for c in ("space", "target"))
    new = np.ones(len(rows), bool)
    new[1:] = [a != b for a, b in zip(zip(space[1:].to_pylist(), target[1:].to_pylist()), zip(space[:-1].to_pylist(), target[:-1].to_pylist()))]
    lists = rows["ids"].combine_chunks()
    ids, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    word = np.repeat(np.cumsum(new) - 1, length)
    base = int(ids.max()) + 1
    pairs, place = np.unique(word.astype(np.int64) * base + ids, return_inverse=True)
    per, own = np.bincount(pairs // base, minlength=int(new.sum())), pairs % base
    first = np.flatnonzero(new)
    chunk = rows["chunk"][0].as_py()
    if chunk < 0:
        known, at, names = own, np.arange(len(own)), target.take(pa.array(np.repeat(first, per)))
    else:
        known, at = np.unique(own, return_inverse=True)
        names = pa.nulls(len(known), pa.string())
    body = _packed(length=length, n=rows["n"].to_numpy(), counts=rows["counts"].combine_chunks().flatten().to_numpy(), step=np.diff(place, prepend=0), at=at, per=per)
    needs = pa.StructArray.from_arrays([pa.array(known, pa.int32()), names.cast(pa.string())], ["id", "target"])
    row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.table(
        {"chunk": pa.array([chunk], pa.int64()), "spaces": row(space.take(pa.array(first)).cast(pa.string())), "targets": row(target.take(pa.array(first)).cast(pa.string())), "needs": row(needs), "body": pa.array([body], pa.binary())}
    )


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays of integers as one compressed Arrow stream."""
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32())) for x in arrays.values()]
    batch, sink = pa.record_batch(columns, list(arrays)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(body).read_next_batch()
    return {name: column.values.to_numpy() for name, column in zip(batch.schema.names, batch.columns)}


def _probable(past: DataFrame, sums: DataFrame, keep: float) -> DataFrame:
    """The current probabilities of target words that are cut; 0 for those that went."""
    joined = sums.filter("target is not null").join(past, "id")
    prob = F.col("c") / F.nullif(F.element_at("sums", -1), F.lit(0.0))
    return joined.withColumn("prob", F.coalesce(F.when((prob > keep) | (F.size("sums") == 1), prob), F.lit(0.0)))


def _told(chunks: DataFrame, past: DataFrame, sums: DataFrame, some_cut: bool, keep: float, *more: str) -> DataFrame:
    """Chunks with what they need to know: all sums so far of each source word, or the probability of each pair of a piece."""
    each = chunks.select("chunk", F.posexplode("needs").alias("at", "x")).select("chunk", "at", "x.id", "x.target")
    met = each.filter("chunk >= 0").join(past, "id").select("chunk", "at", F.col("sums").alias("known"), *more)
    if some_cut:
        pairs = _probable(past, sums, keep).select("id", "target", F.array("prob").alias("known"))
        met = met.unionByName(each.filter("chunk < 0").join(pairs, ["id", "target"]).select("chunk", "at", "known"))
    known = met.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "known", *more))).alias("x"))
    return chunks.join(known.select("chunk", F.col("x.known").alias("known"), *[F.col(f"x.{c}").alias(f"{c}s") for c in more]), "chunk")


class _Tokens:
    """The tokens of a chunk; ``spread`` is one round over them."""

    def __init__(self, body: bytes) -> None:
        a = _unpacked(body)
        self.place, self.at, self.per, self.counts, self.n, self.length = np.cumsum(a["step"]), a["at"], a["per"], a["counts"], a["n"], a["length"]
        self.starts = np.cumsum(self.length) - self.length

    def spread(self, prob: np.ndarray) -> np.ndarray:
        """What each pair gets of the target tokens."""
        weight = prob[self.place] * self.counts
        token = np.add.reduceat(weight, self.starts)
        weight *= np.repeat(np.divide(self.n, token, out=np.zeros(len(token)), where=token > 0), self.length)
        return np.bincount(self.place, weight, len(self.at))

    def probable(self, known: np.ndarray, keep: float) -> np.ndarray:
        """Each pair's probability after the rounds whose sums (a row a round) are known."""
        c = np.ones(len(self.at))
        for n, sums in enumerate(known):
            c = self.spread(prob) if n else c
            total = sums[self.at]
            prob = np.divide(c, total, out=np.zeros(len(c)), where=total > 0)
            if n:
                prob[prob <= keep] = 0
        return prob


def _known(column: pa.Array) -> np.ndarray:
    """One row's list of lists, turned: a row for each round."""
    inner = column.flatten()
    return np.ascontiguousarray(inner.flatten().to_numpy().reshape(len(inner), -1).T)


def _spread(keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                tokens, cut = _Tokens(one["body"][0].as_buffer()), one["chunk"][0].as_py() < 0
                needs = one["needs"].flatten()
                if one["known"].null_count:
                    c = np.ones(len(tokens.at))
                else:
                    known = _known(one["known"])
                    c = tokens.spread(known[0] if cut else tokens.probable(known, keep))
                sums = pa.array(np.bincount(tokens.at, c, len(needs)))
                yield pa.RecordBatch.from_arrays([needs.field("id"), needs.field("target"), sums], ["id", "target", "c"])

    return run


def _table(keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                tokens = _Tokens(one["body"][0].as_buffer())
                prob = tokens.probable(_known(one["known"]), keep)
                stays = np.flatnonzero(prob > 0)
                word = np.repeat(np.arange(len(tokens.per)), tokens.per)
                spaces, targets, sources = (one[c].flatten() for c in ("spaces", "targets", "sources"))
                for some in np.split(stays, range(BATCH, len(stays), BATCH)):
                    own = pa.array(word[some])
                    yield pa.RecordBatch.from_arrays([spaces.take(own), targets.take(own), sources.take(pa.array(tokens.at[some])), pa.array(prob[some])], ["space", "target", "source", "prob"])

    return run
