"""Distinctive phrases of a sample of pages, and lines that pages repeat.

Rarity comes from the collection itself, as the share of pages with a word, since no
licensed table of word frequencies is bundled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import facets as A

# Fixed values of the phrase rules: sample and clip sizes, supports and shares.
SAMPLE, PER_SITE, CLIP, KEPT = 100, 8, 12_000, 40
COMMON, FEW_PAGES = 0.8, 8
#: Characters of text whose phrases one task counts.
TASK = 1 << 22


def page_lines(rows: DataFrame, page: str, site: str, text: str) -> DataFrame:
    """Distinct trimmed lines of each page."""
    lines = rows.select(F.col(page).alias("page"), F.col(site).alias("site"), F.explode(F.split(text, "\n")).alias("line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''").distinct()


def boilerplate(lines: DataFrame) -> DataFrame:
    """Lines that most pages of a site repeat, or many pages of all."""
    pages = lines.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    in_site = lines.groupBy("site", "line").agg(F.count("*").alias("c")).join(pages, "site")
    in_site = in_site.where((F.col("pages") >= 3) & (F.col("c") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.6))))
    total = lines.select("page").distinct().count()
    overall = lines.where(F.length("line") < 200).groupBy("line").agg(F.count("*").alias("c")).where(F.col("c") >= max(5, -(-total // 20)))
    return in_site.select("line").union(overall.select("line")).distinct()


def grams(rows: DataFrame, kept: list[str], text: str, n: int) -> DataFrame:
    """Rows (kept columns, phrase), one for each place of n adjacent words."""
    return _places(rows.select(*kept, X.words(text).alias("__w")), kept, "__w", n)


def _places(rows: DataFrame, kept: list[str], words: str, n: int) -> DataFrame:
    """The phrases of arrays of words; a place's words are read where the words stand, so that no array is built for each."""
    # Fewer words have no places. A filter would be moved before a shuffle below, and the words be found twice.
    places = rows.select(*kept, words, F.explode(F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))).alias("__i"))
    return places.select(*kept, F.concat_ws(" ", *[F.get(words, F.col("__i") + k) for k in range(n)]).alias("phrase"))


def frequent(rows: DataFrame, page: str, site: str, text: str, n: int, least: int) -> DataFrame:
    """Phrases (phrase, pages, sites, most) of n words that at least so many pages hold; most is of one site.

    Places are dealt by phrase once, and every count is taken where they then are: a phrase's
    pages by site, and its sites. Places of a page are counted once, also in several rows.
    Tasks grow in number with the text, not in size; a phrase that most pages hold is in one.
    """
    own = rows.select(F.col(page).alias("page"), F.col(site).alias("site"), F.col(text).alias("text"))
    pages = grams(own, ["page", "site"], "text", n).repartition(_tasks(own, TASK)[0], "phrase").distinct()
    by_site = pages.groupBy("phrase", "site").agg(F.count("*").alias("c"))
    return by_site.groupBy("phrase").agg(F.sum("c").alias("pages"), F.count("*").alias("sites"), F.max("c").alias("most")).where(F.col("pages") >= least)


def counted(rows: DataFrame, page: str, text: str, n: int, least: int) -> DataFrame:
    """Phrases (phrase, pages) of n words that at least so many pages hold.

    Words are dealt by page into slices, where places of a page are counted once, also in
    several rows, and a phrase's pages are added up; a phrase has one row a slice in the
    shuffle, however many pages hold it. Slices and tasks grow in number with the text, not in size.
    """
    own = rows.select(F.col(page).alias("page"), F.col(text).alias("text"))
    slices, tasks = _tasks(own, 3 * TASK // 2, 4 * TASK)
    # Words between spaces take less room in the shuffle than texts or arrays.
    words = own.select("page", F.array_join(X.words("text"), " ").alias("words"), F.pmod(F.xxhash64("page"), F.lit(slices)).cast("int").alias("slice"))
    dealt = words.repartitionById(slices, "slice").select("slice", "page", F.split("words", " ").alias("words"))
    each = _places(dealt, ["slice", "page"], "words", n).distinct().groupBy("slice", "phrase").agg(F.count("*").alias("c"))
    return each.repartition(tasks, "phrase").groupBy("phrase").agg(F.sum("c").alias("pages")).where(F.col("pages") >= least)


def _tasks(rows: DataFrame, *sizes: int) -> list[int]:
    """For each size, how many tasks of so many characters the texts fill, at least Spark's number of shuffle partitions."""
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return [max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // k), 1 << 15)) for k in sizes]


def phrases(lines: DataFrame) -> DataFrame:
    """Distinct (page, phrase, words, bounded) of content-word uni-, bi- and trigrams inside a sentence.

    Content words are numbered by runs without a stop word between; a longer phrase counts
    as bounded in a run of at most four words.
    """
    sentences = lines.select("page", F.posexplode(F.split(F.lower("line"), r"[.!?;|\[\]{}<>]")).alias("s", "sentence"), "line")
    words = sentences.select("page", "line", "s", F.posexplode(F.regexp_extract_all("sentence", F.lit(r"\S+"), F.lit(0))).alias("at", "word"))
    clean = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    content = clean.rlike(r"^\p{L}+(?:['’-]\p{L}+)*$") & F.length(clean).between(3, 24) & ~clean.isin(X.STOPWORDS)
    words = words.withColumn("word", clean).where(content)
    own = Window.partitionBy("page", "line", "s").orderBy("at")
    words = words.withColumn("run", F.col("at") - F.row_number().over(own))
    in_run = Window.partitionBy("page", "line", "s", "run")
    words = words.withColumn("size", F.count("*").over(in_run))
    step = in_run.orderBy("at")
    two, three = F.lead("word", 1).over(step), F.lead("word", 2).over(step)
    grams = F.array_compact(F.array(F.array("word"), F.when(two.isNotNull(), F.array(F.col("word"), two)), F.when(three.isNotNull(), F.array(F.col("word"), two, three))))
    flat = words.withColumn("grams", grams).select("page", "size", F.explode("grams").alias("parts"))
    flat = flat.select("page", F.array_join("parts", " ").alias("phrase"), "parts", (F.col("size") <= 4).alias("bounded"))
    return flat.groupBy("page", "phrase", "parts").agg(F.bool_or("bounded").alias("bounded"))


def distinctive(rows: DataFrame, page: str, site: str, text: str, seed: str) -> DataFrame:
    """The phrases (phrase, pages, score, place) that set a seeded sample of pages apart."""
    order = F.md5(F.concat(F.lit(seed), F.col(page).cast("string")))
    picked = rows.select(page, site, F.substring(text, 1, CLIP).alias("text"), order.alias("__order"))
    picked = A.top_of(picked, [site], PER_SITE, F.asc("__order"), F.asc(page)).orderBy("__order", page).limit(SAMPLE)
    picked = A.first_of(picked.withColumn("__same", F.sha2(X.collapsed("text"), 256)).where(F.trim("text") != ""), ["__same"], F.asc(page))
    lines = page_lines(picked.withColumn("text", X.plain("text")), page, site, "text").persist()
    found = phrases(lines.join(boilerplate(lines), "line", "left_anti"))
    total = lines.select("page").distinct().count()
    lines.unpersist()
    counts = found.groupBy("phrase", "parts").agg(F.count("*").alias("pages"), F.bool_or("bounded").alias("bounded")).persist()
    single = counts.where(F.size("parts") == 1).select(F.col("phrase").alias("word"), F.col("pages").alias("word_pages"))
    each = counts.select("phrase", F.explode("parts").alias("word")).join(single, "word")
    rarity = F.avg(F.greatest(F.lit(0.0), F.log10(F.lit(float(max(total, 1))) / F.col("word_pages")) * 2.5)).alias("rarity")
    each = each.groupBy("phrase").agg(rarity, F.max("word_pages").alias("most"))
    rows = counts.join(each, "phrase").where((F.size("parts") == 1) | F.col("bounded"))
    if total >= FEW_PAGES:
        rows = rows.where((F.col("pages") >= 2) & (F.col("most") < COMMON * total))
    score = F.col("pages") * F.pow("rarity", F.lit(2.0)) * F.pow(F.size("parts").cast("double"), F.lit(1.5)) * F.col("pages") / F.col("most")
    best = rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "phrase").limit(10 * KEPT).select("phrase", "pages", "score")
    return A.ranked(_apart(best), F.desc("score"), F.asc("phrase"), window=KEPT).withColumnRenamed("rank", "place")


def _apart(best: DataFrame) -> DataFrame:
    """Without phrases inside a better one of as many pages; a few hundred rows."""
    outer = best.select(F.col("phrase").alias("__o"), F.col("pages").alias("pages"), F.col("score").alias("__s"))
    inside = F.contains(F.concat(F.lit(" "), "__o", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" "))) & (F.col("__o") != F.col("phrase"))
    better = (F.col("__s") > F.col("score")) | ((F.col("__s") == F.col("score")) & (F.col("__o") < F.col("phrase")))
    gone = best.join(outer, "pages").where(inside & better).select("phrase").distinct()
    return best.join(gone, "phrase", "left_anti")
