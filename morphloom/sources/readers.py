"""Sources: line-aligned text, JSON lines, tables, treebanks, dictionaries, question blocks.

Everything is read with a declared schema, in the executors; no reader infers
or collects. Malformed rows are dropped or null, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphloom.functions.text import tokens

MORPH = "form string, gloss string, boundary string"
IGT = "id string, source string, transcription string, translation string, glottocode string, language string, metalanguage string, metalang_glottocode string, segmentation string, glosses string"
CHANGE = "op string, key string, fields map<string,string>, confidence double, rationale string, provenance map<string,string>, status string, locked boolean, rounds_seen bigint"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): the lines of text files, numbered from 1 in each file.

    A file is read whole and split where it lies, so numbers are exact; line ends
    of any kind count.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.split(F.regexp_replace("value", "(\\r\\n|\\r|\\n)$", ""), "\\r\\n|\\r|\\n")
    return whole.select("file", F.posexplode(lines).alias("at", "text")).select("file", (F.col("at") + 1).cast("bigint").alias("line_no"), "text")


def parallel_lines(refs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(ref, src, tgt): three line-aligned texts as token rows.

    Lines beyond the shortest text, blank ones, ``<range>`` marks, and rows
    without a token on either side are left out. Each side: (line_no, text).
    """
    name = lambda df, c: df.select("line_no", F.trim("text").alias(c))
    rows = name(refs, "ref").join(name(source, "s"), "line_no").join(name(target, "t"), "line_no")
    good = rows.filter(~F.col("s").isin("", "<range>") & ~F.col("t").isin("", "<range>"))
    return good.select("ref", tokens(F.col("s")).alias("src"), tokens(F.col("t")).alias("tgt")).filter((F.size("src") > 0) & (F.size("tgt") > 0))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; unreadable lines give null rows, which are dropped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.dropna("all")


def gloss_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(target, source, prob, count): a gloss table with a header; rows whose numbers cannot be read have nulls."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("target string, source string, prob string, count string").csv(path)
    return raw.select("target", "source", F.expr("try_cast(prob as double)").alias("prob"), F.expr("try_cast(count as bigint)").alias("count"))


def paradigms_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, form, features): inflection tables, in lower case; lines without three fields are dropped."""
    fields = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(fields) == 3).select(F.lower(fields[0]).alias("lemma"), F.lower(fields[1]).alias("form"), fields[2].alias("features"))


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma, upos): the words of CoNLL-U text; comments, multiword ranges and empty nodes are skipped."""
    fields = F.split("value", "\t")
    good = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(fields) >= 4) & fields[0].rlike("^[0-9]+$"))
    return good.select(F.lower(fields[1]).alias("form"), F.lower(fields[2]).alias("lemma"), fields[3].alias("upos"))


def xml_elements(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """The elements named ``row_tag`` of XML files as rows; malformed ones are dropped."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(schema).load(path)


def bilingual_xml(spark: SparkSession, path: str) -> DataFrame:
    """(reference, reference_tags, vernacular, vernacular_tags): entries ``<e><p><l>..<s n=""/></l><r>..</r></p></e>``."""
    df = xml_elements(spark, path, "e", "p struct<l:string,r:string>")
    lemma = lambda c: F.trim(F.regexp_extract(c, r'(?s)^(.*?)(?:<s n="|$)', 1))
    tags = lambda c: F.regexp_extract_all(c, F.lit('<s n="([^"]*)"'), 1)
    return df.select(lemma("p.l").alias("reference"), tags("p.l").alias("reference_tags"), lemma("p.r").alias("vernacular"), tags("p.r").alias("vernacular_tags"))


def token_stream(texts: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, at, surface, analysis, lemma, tags): tokens ``^surface/lemma<tag>../..$``, one row for each analysis."""
    units = texts.select(*keys, F.posexplode(F.regexp_extract_all(column, F.lit(r"\^(.*?)\$"), 1)).alias("at", "unit"))
    parts = units.withColumn("parts", F.split("unit", "/")).withColumn("surface", F.col("parts")[0])
    one = parts.select(*keys, "at", "surface", F.posexplode(F.slice("parts", F.lit(2), F.size("parts"))).alias("analysis", "reading"))
    return one.select(*keys, "at", "surface", "analysis", F.regexp_extract("reading", "^([^<]*)", 1).alias("lemma"), F.regexp_extract_all("reading", F.lit("<([^>]+)>"), 1).alias("tags"))


def question_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, prompt, gold): blocks ``Question N:`` .. ``Correct Answer: X``; blocks without an answer are skipped."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    blocks = whole.select("file", F.explode(F.split("value", "(?m)(?=^Question \\d+:)")).alias("block"))
    number, gold = F.regexp_extract("block", r"^Question (\d+):", 1), F.regexp_extract("block", r"(?m)^Correct Answer:\s*\(?([A-Z])", 1)
    named = blocks.select("file", number.alias("number"), F.trim(F.regexp_replace("block", r"(?ms)^Correct Answer:.*", "")).alias("prompt"), gold.alias("gold"))
    return named.filter((F.col("number") != "") & (F.col("gold") != "")).withColumn("number", F.col("number").cast("bigint"))


def glossed_words(rows: DataFrame, keys: list[str], segmentation: str = "segmentation", glosses: str = "glosses") -> DataFrame:
    """(keys, at, surface, morph, form, gloss, boundary): words of interlinear text, morph by morph.

    Rows whose segmentation and glosses differ in words are dropped, words that
    differ in morphs or boundaries too.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    good = rows.filter(F.size(words(segmentation)) == F.size(words(glosses)))
    each = good.select(*keys, F.posexplode(F.arrays_zip(words(segmentation).alias("s"), words(glosses).alias("g"))).alias("at", "w"))
    marks = lambda c: F.regexp_extract_all(c, F.lit("[-=]"), 0)
    split = each.select(*keys, "at", F.col("w.s").alias("s"), F.col("w.g").alias("g")).filter(marks("s") == marks("g"))
    parts = F.arrays_zip(F.split("s", "[-=]").alias("form"), F.split("g", "[-=]").alias("gloss"), F.concat(F.array(F.lit("")), marks("s")).alias("boundary"))
    out = split.select(*keys, "at", F.regexp_replace("s", "[-=]", "").alias("surface"), F.posexplode(parts).alias("morph", "m"))
    return out.select(*keys, "at", "surface", "morph", "m.form", "m.gloss", "m.boundary")


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key: how an append-only log of records is read."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__k = 1").drop("__k")


def dictionary_dump(spark: SparkSession, path: str, senses: int = 8) -> DataFrame:
    """(word, pos, senses, forms): entries of a JSON-lines dictionary, one row a word: distinct parts of speech, its first senses, forms without blanks.

    Lines: word, pos, senses (gloss lists), forms (form records). Order is that of file and line.
    """
    schema = "word string, pos string, senses array<struct<glosses:array<string>>>, forms array<struct<form:string>>"
    rows = json_lines(spark, path, schema).filter("word is not null").withColumn("at", F.monotonically_increasing_id())
    flat = rows.select(F.lower("word").alias("word"), "pos", "at", F.flatten(F.transform(F.coalesce("senses", F.array().cast("array<struct<glosses:array<string>>>")), lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>")))).alias("g"), F.transform("forms", lambda f: f["form"]).alias("f"))
    one = flat.groupBy("word").agg(F.array_sort(F.collect_set("pos")).alias("pos"), F.array_sort(F.collect_list(F.struct("at", "g"))).alias("s"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("f", F.array().cast("array<string>"))))).alias("forms"))
    listed = F.slice(F.array_distinct(F.flatten(F.transform("s", lambda x: x["g"]))), 1, senses)
    return one.select("word", "pos", listed.alias("senses"), F.filter("forms", lambda x: x.isNotNull() & ~F.contains(x, F.lit(" "))).alias("forms"))


def key_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term): names of the text files a JSON directory listing holds."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<name:string>>")).alias("e"))
    return rows.filter(F.col("e.name").endswith(".md")).select(F.regexp_replace("e.name", r"\.md$", "").alias("term")).distinct()


def audio_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(target, source_id, anchor, path, licence): the assets of an audio catalog, unusable ones dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<target:string,source_id:string,anchor:string,path:string,licence:string>>")).alias("e")).select("e.*")
    return rows.filter("target is not null and source_id is not null and path is not null")


def element_counts(spark: SparkSession, path: str, buckets: dict[str, str]) -> DataFrame:
    """(bucket, n): how often XML elements stand in files, by local name; ``buckets`` names what is counted.

    Start tags are counted where the files are read; comments are left out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("v"))
    names = whole.select(F.explode(F.regexp_extract_all("v", F.lit(r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)"), 1)).alias("name"))
    table = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair])
    return names.withColumn("bucket", F.try_element_at(table, F.col("name"))).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def lift_entries(spark: SparkSession, path: str) -> DataFrame:
    """(form, pos, gloss): entries of LIFT dictionaries; those without a form are dropped."""
    schema = "`lexical-unit` struct<form:array<struct<text:string>>>, sense array<struct<`grammatical-info`:struct<_value:string>,gloss:array<struct<text:string>>>>"
    df = xml_elements(spark, path, "entry", schema)
    sense = F.try_element_at("sense", F.lit(1))
    rows = df.select(F.try_element_at(F.col("lexical-unit.form"), F.lit(1))["text"].alias("form"), sense["grammatical-info"]["_value"].alias("pos"), F.try_element_at(sense["gloss"], F.lit(1))["text"].alias("gloss"))
    return rows.filter("form is not null and form <> ''")
