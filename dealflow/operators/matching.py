"""Columns against the field catalogue (D1 to D19): scores, conflicts, tiers and reviews, for many files at once.

Columns are compared with the catalogue of 33 fields and about 150 aliases, whose size is fixed; never with each
other. columns: (file, col_index, col_name) and the profile columns of column_profiles().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import BOOSTS, FIELDS, OPTIONAL, PATTERNS
from .segments import first_rows

c = F.col
REVIEW, AUTO = 0.50, 0.85
FIELD_IDS = [f[0] for f in FIELDS]
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
URL = r"(?i)https?://|www\.|\.(com|net|org|io|co)\b"


def norm(header: Column) -> Column:
    """Without accents, footnotes and punctuation, lower case."""
    s = F.regexp_replace(F.translate(header, _ACCENTED, _PLAIN), r"[^\x00-\x7f]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\([a-z]+\)", " "), r"\(\d+\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9 ]+", " "), r"\s+", " "))


def tokens(header: Column) -> Column:
    """D2."""
    return F.filter(F.array_distinct(F.split(norm(header), " ")), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """0 where either side has no tokens."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def catalogue(spark: SparkSession) -> DataFrame:
    """(field_id, field_ord, label, aliases), 33 rows."""
    return spark.createDataFrame([(f, i, label, list(a)) for i, (f, label, a, _) in enumerate(FIELDS)], "field_id string, field_ord int, label string, aliases array<string>")


def _pattern_score(field: Column, name: Column) -> Column:
    """The confidence of the first pattern of the field that the normalised name matches."""
    out = None
    for f, patterns in PATTERNS.items():
        score = F.coalesce(*(F.when(name.rlike(p), s) for p, s in patterns), F.lit(0.0))
        out = F.when(field == f, score) if out is None else out.when(field == f, score)
    return out.otherwise(0.0)


def _boost(field: Column) -> Column:
    """D6."""
    out = None
    for f, (looks, boost) in BOOSTS.items():
        value = F.when(c(f"looks_{looks}"), boost).otherwise(0.0)
        out = F.when(field == f, value) if out is None else out.when(field == f, value)
    return out.otherwise(0.0)


def company_multiplier() -> Column:
    """How plausible a column's values are as company names."""
    s = F.filter(F.transform("samples", lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(s)
    mean = lambda f: F.aggregate(F.transform(s, f), F.lit(0.0), lambda a, x: a + x) / n
    filled = F.greatest(F.lit(1.0), c("rows") * c("fill_rate"))
    return (
        F.when(c("data_type").isin("numeric", "percent", "date"), 0.1)
        .when(c("fill_rate") < 0.3, 0.3)
        .when(F.coalesce(n, F.lit(0)) <= 0, 0.3)
        .when(mean(lambda x: x.rlike(URL).cast("double")) > 0.3, 0.15)
        .when((mean(lambda x: F.length(x).cast("double")) > 60) | (mean(lambda x: F.size(F.split(x, r"\s+")).cast("double")) > 7), 0.3)
        .when(c("distinct") / filled < 0.35, 0.4)
        .otherwise(1.0)
    )


def company_likeness() -> Column:
    """0 to 0.9 by the values alone."""
    s = F.filter(F.transform("samples", lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(s)
    mean = lambda f: F.aggregate(F.transform(s, f), F.lit(0.0), lambda a, x: a + x) / n
    unique = F.least(F.lit(1.0), c("distinct") / F.greatest(F.lit(1.0), c("rows") * c("fill_rate")))
    length = mean(lambda x: F.length(x).cast("double"))
    score = 0.40 + 0.25 * unique + 0.15 * c("fill_rate") + F.when(c("col_index") <= 2, 0.08).otherwise(0.0)
    return (
        F.when(c("data_type").isin("numeric", "percent", "date", "empty") | (F.coalesce(n, F.lit(0)) <= 0) | (c("fill_rate") < 0.5), 0.0)
        .when(mean(lambda x: x.rlike(URL).cast("double")) > 0.2, 0.0)
        .when(~((length >= 2) & (length <= 45) & (mean(lambda x: F.size(F.split(x, r"\s+")).cast("double")) <= 6)), 0.0)
        .when(unique < 0.5, 0.0)
        .otherwise(F.least(score, F.lit(0.9)))
    )


def scores(columns: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(file, col_index, col_name, field_id, field_ord, confidence, signals) where anything speaks for it.

    vectors: (file, col_index, vector) of headers and (field_id, field_vector) of fields, from any model; columns whose
    best confidence stays below REVIEW then take their similarity to a field where it is higher (D8).
    """
    d = columns.withColumns({"nc": norm(c("col_name")), "toks": tokens(c("col_name")), "mult": company_multiplier()})
    cat = catalogue(columns.sparkSession).withColumn("norms", F.transform("aliases", norm)).withColumn("bags", F.transform(F.concat(F.array("label"), c("aliases")), tokens))
    d = d.crossJoin(F.broadcast(cat))  # 33 rows, fixed
    overlap = lambda a: F.length(a) / F.greatest(F.length("nc"), F.length(a))
    alias = F.transform("norms", lambda a: F.when(c("nc") == a, 0.95).when((c("nc").contains(a) | F.coalesce(a.contains(c("nc")), F.lit(False))) & (overlap(a) >= 0.7), 0.80 + 0.10 * overlap(a)))
    first = F.coalesce(F.get(F.filter(alias, lambda x: x.isNotNull()), F.lit(0)), F.lit(0.0))
    best = F.array_max(F.transform("bags", lambda t: jaccard(c("toks"), t)))
    d = d.withColumns({"a": first, "r": _pattern_score(c("field_id"), c("nc")), "j": best, "p": _boost(c("field_id"))})
    d = d.withColumn("f", F.when(c("j") >= 0.40, F.least(F.lit(0.85), 0.50 + (c("j") - 0.40) * 3.5)).otherwise(0.0))
    d = d.withColumn("primary", F.greatest("a", "r", "f"))
    d = d.withColumn("confidence", F.least(F.lit(1.0), c("primary") + F.when(c("primary") >= 0.30, c("p")).otherwise(0.0)))
    signal = lambda x, name: F.when(c(x) > 0, name)
    named = F.array(signal("a", "alias"), signal("r", "pattern"), signal("f", "tokens"), F.when((c("primary") >= 0.30) & (c("p") > 0), "profile"))
    d = d.select("file", "col_index", "col_name", "field_id", "field_ord", "mult", "confidence", F.array_compact(named).alias("signals"))
    if vectors is not None:
        d = _with_similarity(d, *vectors)
    company = c("field_id") == "company"
    signals = F.when(company & (c("mult") < 1), F.concat("signals", F.array(F.lit("penalised")))).otherwise(c("signals"))
    return d.select("file", "col_index", "col_name", "field_id", "field_ord", F.when(company, c("confidence") * c("mult")).otherwise(c("confidence")).alias("confidence"), signals.alias("signals")).where("confidence > 0")


#: Field vectors that one column meets at a time.
BLOCK = 256


def similarities(vectors: DataFrame, field_vectors: DataFrame, least: float = 0.45) -> DataFrame:
    """The rows of vectors (..., vector) with each field_id whose cosine is at least ``least``, and cos; others have none.

    Fields travel in blocks of BLOCK vectors, numbered by ranges of a sort, and each row meets each block: all rows of the
    stated set against all fields, with one row a pair only where it is similar. Vectors of other lengths, nulls and zeros are similar to nothing.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    blocks = field_vectors.withColumn("block", F.floor((F.row_number().over(Window.orderBy("field_id")) - 1) / BLOCK))
    blocks = blocks.withColumn("length", F.sqrt(dot(c("field_vector"), c("field_vector")))).where("length > 0")
    blocks = blocks.groupBy("block").agg(F.collect_list(F.struct("field_id", "field_vector", "length")).alias("fields")).select("fields")
    own = vectors.withColumn("__length", F.sqrt(dot(c("vector"), c("vector"))))
    cosines = F.transform("fields", lambda f: F.struct(f["field_id"].alias("field_id"), F.try_divide(dot(c("vector"), f["field_vector"]), c("__length") * f["length"]).alias("cos")))
    met = own.join(blocks).select(*vectors.columns, F.inline(F.filter(cosines, lambda x: F.coalesce(x["cos"] >= least, F.lit(False)))))
    return met.select(*vectors.columns, "field_id", "cos")


def _with_similarity(scored: DataFrame, column_vectors: DataFrame, field_vectors: DataFrame) -> DataFrame:
    """Scores of columns that reach REVIEW nowhere, raised to 0.85 of their cosine where that is higher."""
    key = ["file", "col_index"]
    low = scored.groupBy(*key).agg(F.max("confidence").alias("top")).where(c("top") < REVIEW).select(*key)
    near = similarities(column_vectors.select(*key, "vector").join(low, key), field_vectors)
    near = near.groupBy(*key, "field_id").agg(F.max("cos").alias("cos"))
    d = scored.join(near, [*key, "field_id"], "left").withColumn("sem", c("cos") * 0.85)
    d = d.withColumn("__higher", F.coalesce(c("sem") > c("confidence"), F.lit(False)))
    d = d.withColumn("signals", F.when(c("__higher"), F.concat("signals", F.array(F.lit("semantic")))).otherwise(c("signals")))
    return d.withColumn("confidence", F.when(c("__higher"), c("sem")).otherwise(c("confidence"))).drop("cos", "sem", "__higher")


def semantic(column_vectors: DataFrame, field_vectors: DataFrame) -> DataFrame:
    """The best field of each column by cosine, from embeddings given as data; (key, field_id, confidence)."""
    d = similarities(column_vectors, field_vectors).groupBy("key").agg(F.max_by("field_id", F.struct("cos", "field_id")).alias("field_id"), F.max("cos").alias("cos"))
    return d.select("key", "field_id", (c("cos") * 0.85).alias("confidence"))


def resolve(scored: DataFrame) -> DataFrame:
    """Greedy by confidence, each column and field of a file once; ties go by field and column order.

    The other fields take as many columns as there are other fields at most, so each field's best columns, one more than
    that, hold the one it gets: a file's list is bounded by the catalogue, however many columns it has.
    """
    item = F.struct((-c("confidence")).alias("neg"), "field_ord", "col_index", "field_id", "col_name", "signals")
    best = F.row_number().over(Window.partitionBy("file", "field_id").orderBy(F.desc("confidence"), "col_index"))
    d = scored.where(c("confidence") >= REVIEW).withColumn("k", best).where(c("k") <= len(FIELDS)).groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    taken = F.aggregate("items", none, lambda acc, x: F.when(F.exists(acc, lambda t: (t["field_id"] == x["field_id"]) | (t["col_index"] == x["col_index"])), acc).otherwise(F.concat(acc, F.array(x))))
    return d.select("file", F.inline(taken)).select("file", "field_id", "field_ord", "col_index", "col_name", (-c("neg")).alias("confidence"), "signals")


def rescued(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """Files without a company column get the free column whose values look most like names."""
    have = mapping.where("field_id = 'company'").select("file").distinct()
    free = columns.join(mapping.select("file", "col_index"), ["file", "col_index"], "left_anti").join(have, "file", "left_anti")
    free = free.withColumn("s", company_likeness()).where("s >= 0.55")
    best = free.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("s"), "col_index"))).where("k = 1")
    order = [i for i, f in enumerate(FIELDS) if f[0] == "company"][0]
    new = best.select("file", F.lit("company").alias("field_id"), F.lit(order).alias("field_ord"), "col_index", "col_name", F.least(F.lit(0.65), c("s")).alias("confidence"), F.array(F.lit("values")).alias("signals"))
    return mapping.unionByName(new)


def tier(confidence: Column) -> Column:
    """D12."""
    return F.when(confidence >= AUTO, "green").when(confidence >= REVIEW, "yellow").otherwise("red")


def mapping(columns: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every field of every file with its column, confidence, signals, status and tier; unmapped fields included. vectors: see scores()."""
    found = rescued(resolve(scores(columns, vectors)), columns)
    fields = catalogue(columns.sparkSession).select("field_id", "field_ord", "label")
    every = columns.select("file").distinct().crossJoin(F.broadcast(fields))
    d = every.join(found.drop("field_ord"), ["file", "field_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    status = F.when(c("confidence") >= AUTO, "auto_confirmed").when(c("confidence") >= REVIEW, "needs_review").otherwise("unmapped")
    return d.withColumns({"status": status, "tier": tier(c("confidence")), "optional": c("field_id").isin(*OPTIONAL)})


def unmapped_columns(columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """D12."""
    return columns.select("file", "col_index", "col_name").join(mapped.where("col_index IS NOT NULL").select("file", "col_index"), ["file", "col_index"], "left_anti")


def review_queue(mapped: DataFrame) -> DataFrame:
    """Fields by what a reviewer has to do."""
    queue = F.when(c("status") == "auto_confirmed", "confirmed").when((c("status") == "unmapped") & c("optional"), "expected_gaps").otherwise("review")
    return mapped.withColumn("queue", queue).groupBy("file", "queue").agg(F.count("*").alias("fields"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_ord", "field_id"))), lambda x: x["field_id"]), ", ").alias("field_ids"))


def review_report(mapped: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts by status and of issues, whether the file is clean, and a line of summary. issues: (file, severity)."""
    a = mapped.groupBy("file").agg(*(F.count_if(c("status") == s).alias(s) for s in ("auto_confirmed", "needs_review", "unmapped")))
    b = issues.groupBy("file").agg(F.count_if(c("severity") == "error").alias("errors"), F.count_if(c("severity") == "warning").alias("warnings"))
    d = a.join(b, "file", "left").fillna(0, ["errors", "warnings"])
    text = F.concat_ws(", ", *(F.concat(c(x).cast("string"), F.lit(f" {x.replace('_', ' ')}")) for x in ("auto_confirmed", "needs_review", "unmapped", "errors", "warnings")))
    return d.withColumns({"is_clean": (c("needs_review") == 0) & (c("errors") == 0), "summary": text})


def mapping_log(mapped: DataFrame) -> DataFrame:
    """D14."""
    return mapped.select("file", "label", "col_name", F.round("confidence", 4).alias("confidence"), "tier")


def overridden(mapped: DataFrame, manual: DataFrame) -> DataFrame:
    """A stored choice (file, field_id, column) replaces the inferred column."""
    return mapped.join(manual, ["file", "field_id"], "left").withColumn("col_name", F.coalesce("column", "col_name")).drop("column")


def save_mapping(mapped: DataFrame, gp_name: Column, folder: str) -> None:
    """Stores the mapped columns of each manager (field_id, col_name) under a key of its name; replaces what it had."""
    rows = mapped.where("col_name IS NOT NULL").select(slug(gp_name).alias("slug"), "file", "field_id", "col_name")
    rows.write.partitionBy("slug").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def load_mapping(spark: SparkSession, folder: str, *gp_names: str) -> DataFrame:
    """(slug, file, field_id, column) as stored for the named managers, of all without names; none where nothing is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "file string, field_id string, col_name string, slug string"
    stored = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder) if stored else spark.createDataFrame([], schema)
    rows = rows.withColumnRenamed("col_name", "column")
    if gp_names:
        keys = spark.createDataFrame([(n,) for n in gp_names], "name string").select(slug(c("name")).alias("slug")).distinct()
        rows = rows.join(keys, "slug", "left_semi")
    return rows.select("slug", "file", "field_id", "column")


def slug(name: Column) -> Column:
    """A key for a manager's stored choices."""
    s = F.regexp_replace(F.lower(F.regexp_replace(F.translate(name, _ACCENTED, _PLAIN), r"[^\x00-\x7f]", "")), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "unknown_gp").otherwise(s)


def _plain(header: Column) -> Column:
    s = F.regexp_replace(F.lower(header), r"\([a-z0-9]+\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9 ]+", " "), r"\s+", " "))


def rule_match(columns: DataFrame) -> DataFrame:
    """The field of the longest alias that contains a header or is contained in it."""
    names = catalogue(columns.sparkSession).select("field_id", "field_ord", F.posexplode("aliases").alias("alias_ord", "alias")).withColumn("a", _plain(c("alias")))
    d = columns.select("file", "col_index", "col_name", _plain(c("col_name")).alias("n")).crossJoin(F.broadcast(names))  # the aliases, fixed
    d = d.where(c("n").contains(c("a")) | c("a").contains(c("n")))
    key = F.struct(F.length("a").alias("l"), (-c("field_ord")).alias("f"), (-c("alias_ord")).alias("o"))
    return d.groupBy("file", "col_index", "col_name").agg(F.max_by("field_id", key).alias("field_id"))


def value_match(cells: DataFrame) -> DataFrame:
    """A field by the first 50 values of a column: dates, multiples or rates."""
    v = F.trim("value")
    d = first_rows(cells.where("value IS NOT NULL"), ["file", "col_index", "col_name"], "row_no", 50)
    multiple = v.rlike(r"^\d+\.?\d*x?$") & F.coalesce((F.regexp_replace(v, "x+$", "").try_cast("double") > 0) & (F.regexp_replace(v, "x+$", "").try_cast("double") < 25), F.lit(False))
    rate = F.regexp_replace(v, "%+$", "").try_cast("double")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    g = d.groupBy("file", "col_index", "col_name").agg(share(v.rlike(r"^\d{4}-\d{2}-\d{2}")).alias("d"), share(multiple).alias("m"), share((rate > -0.5) & (rate < 1.5)).alias("r"))
    return g.select("file", "col_index", "col_name", F.when(c("d") > 0.6, "entry_date").when(c("m") > 0.7, "gross_moic").when(c("r") > 0.7, "gross_irr").alias("field_id"))


def layered(columns: DataFrame, cells: DataFrame, third: DataFrame | None = None) -> DataFrame:
    """By rules (0.95), else by values (0.75), else by a third layer of scores; the first column of a field wins."""
    keys = ["file", "col_index", "col_name"]
    one = rule_match(columns).select(*keys, "field_id", F.lit(1).alias("layer"), F.lit(0.95).alias("confidence"))
    firsts = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("file", "field_id").orderBy("layer", "col_index"))).where("k = 1").drop("k")
    done = firsts(one)
    for layer, new in ((2, value_match(cells).where("field_id IS NOT NULL").withColumn("confidence", F.lit(0.75))), (3, third)):
        if new is not None:
            new = new.join(done.select("file", "col_index"), ["file", "col_index"], "left_anti").select(*keys, "field_id", F.lit(layer).alias("layer"), "confidence")
            done = firsts(done.unionByName(new))
    return done


def by_position(columns: DataFrame, positions: DataFrame) -> DataFrame:
    """(file, field_id, col_index) to column names; null where a file has no such column."""
    return positions.join(columns.select("file", "col_index", "col_name"), ["file", "col_index"], "left")
