"""Rule-based quality filter: surface rules, then divergence from what is usual in the document's language.

Everything is built from DataFrame functions. Two scans of the text: one gathers, per language, how often each
character class and each word occurs in all documents; the other measures every document and compares its
histograms with those of its language by the Jensen-Shannon distance (base 2, so 0 to 1). The word histogram has a bin for
each of the language's most common words, one for marks that stand alone, and one for all other words.

Defined results: null text counts as empty; an empty text has no words, fails the base rules and isn't kept; null
languages, and those too rare for a reference, are compared with the reference of all documents; rows repeat as they are
given; other columns are ignored by `measure` and kept by `kept_documents` (whatever their names) and `apply_rules`
(but for those named as what it adds, or ending in an underscore as its temporary ones: ADDED and TEMPORARY). Words of
3-word windows are compared by a 64-bit hash of the three. No group is ever collected: references are sums, one row a language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.llm.common import WHITE_SPACE, checkpointed, join_small, quoted, shielded

#: Character classes of the histogram, in this order; the last holds what no other has (mostly lower-case letters).
CLASSES = ("upper", "digit", "mark", "symbol", "space", "other")
SYMBOLS = r"#*$%&|<>"
#: Words without any of these are marks that stand alone; the word histogram has one bin for all of them.
LETTERS = r"[\p{L}\p{N}]"
#: Key of the reference that is made of all documents.
ANY = "*"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
TEMPORARY = ("text_", "words_", "residue_", "lower_", "classes_", "lines_", "windows_", "sorted_", "common_", "word_ref_", "class_ref_", "ref_lang_", "hits_", "lone_", "has_own_")


@dataclass(frozen=True)
class QualityParams:
    """Thresholds. A document is compared only above the two minimum lengths."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 20
    #: A language needs so many words in all documents for a reference of its own.
    min_reference_words: int = 2000
    min_chars: int = 100
    min_compared_words: int = 50
    max_class_distance: float = 0.27
    max_word_distance: float = 0.35


def _class_counts(text: Column, words: Column, residue: Column) -> Column:
    """Histogram over CLASSES as an array of longs. residue: the text without white space and lower-case letters."""
    total = F.length(text).cast("long")
    space = total - F.length(F.array_join(words, ""))
    upper, digit, mark, symbol = (F.length(F.regexp_replace(residue, f"[^{c}]+", "")).cast("long") for c in (r"\p{Lu}", "0-9", r".,;:!?'\"()\-", SYMBOLS))
    return F.array(upper, digit, mark, symbol, space, total - upper - digit - mark - symbol - space)


def with_words(docs: DataFrame) -> DataFrame:
    """Add text_ (never null), words_, classes_ and lower_ (the words in lower case)."""
    df = docs.withColumn("text_", F.coalesce(F.col("text"), F.lit("")))
    words = lambda t: F.array_remove(F.split(t, WHITE_SPACE), "")
    df = df.withColumn("words_", words(F.col("text_"))).withColumn("residue_", F.regexp_replace("text_", r"[\p{Ll}\x20\x09-\x0D]+", ""))
    return df.withColumn("classes_", _class_counts(F.col("text_"), F.col("words_"), F.col("residue_"))).withColumn("lower_", words(F.lower("text_")))


def references(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per language and one for all: ref_lang_, common_ array<string>, word_ref_ array<double> (two more: lone marks and the rest), class_ref_ array<double>."""
    base = with_words(docs.select(F.coalesce("lang", F.lit(ANY)).alias("lang"), "text"))
    # One row per word (one with a null key if there are none); a document's other counts go with its first row.
    counted = base.select("lang", "classes_", F.posexplode_outer("lower_").alias("pos", "key"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    sums = counted.groupBy("lang", "key").agg(F.count("key").alias("n"), *(F.sum(F.when(first, F.col("classes_")[i])).alias(c) for i, c in enumerate(CLASSES)))
    sums = checkpointed(sums)
    measures = ("n", *CLASSES)
    all_ = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in measures)).select(F.lit(ANY).alias("lang"), "key", *measures)
    sums = sums.where(F.col("lang") != ANY).unionByName(all_)
    lone = F.sum(F.when(~F.col("key").rlike(LETTERS), F.col("n")).otherwise(0)).alias("lone")
    totals = sums.groupBy("lang").agg(lone, F.sum("n").alias("words"), *(F.sum(c).alias(c) for c in CLASSES)).where(F.col("words") >= params.min_reference_words)
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = sums.where(F.col("key").rlike(LETTERS)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= params.common_words)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "n"))).alias("top"))
    chars = sum((F.col(c) for c in CLASSES), F.lit(0))
    covered = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return totals.join(top, "lang").select(
        F.col("lang").alias("ref_lang_"),
        F.transform("top", lambda x: x["key"]).alias("common_"),
        F.concat(F.transform("top", lambda x: x["n"] / F.col("words")), F.array(F.col("lone") / F.col("words"), (F.col("words") - F.col("lone") - covered) / F.col("words"))).alias("word_ref_"),
        F.array(*(F.col(c) / chars for c in CLASSES)).alias("class_ref_"),
    )


def _js_distance(p: Column, q: Column) -> Column:
    """Of two histograms that each sum to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def measure(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), lower_ and classes_."""
    df = with_words(docs)
    lines = F.filter(F.split("text_", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("n_words", F.size("words_").cast("long")).withColumn("lines_", lines)
    numbers = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("words_") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("windows_", F.transform(numbers, lambda i: F.xxhash64(F.col("words_")[i], F.col("words_")[i + 1], F.col("words_")[i + 2])))
    some = F.size(F.array_distinct("windows_")) < F.size("windows_")
    df = df.withColumn("sorted_", F.when(some, F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s, last = F.col("sorted_"), F.size("sorted_") - 1
    repeated = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < last) & (s[F.least(j + 1, last)]["h"] == x["h"])))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))
    return df.select(
        *map(quoted, docs.columns),
        "lower_",
        "classes_",
        "n_words",
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.col("classes_")[CLASSES.index("symbol")].alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["n"], F.lit(0)).alias("n_repeat_words"),
    )


def _fenced(df: DataFrame, name: str) -> Column:
    """The column, as an expression that Spark can't push a filter through: that would compute the words once per use of a word."""
    here = F.monotonically_increasing_id()
    kind = dict(df.dtypes)[name]
    return F.col(name) & (here >= 0) if kind == "boolean" else F.col(name) + F.least(here, F.lit(0)).cast(kind)


def apply_rules(docs: DataFrame, params: QualityParams = QualityParams(), refs: DataFrame | None = None) -> DataFrame:
    """docs (without columns named in ADDED and TEMPORARY) with the measures, base_failed, class_distance, word_distance (null where there is nothing to compare) and kept."""
    docs = docs.drop(*(c for c in docs.columns if c in (*ADDED, *TEMPORARY)))
    refs = checkpointed(references(docs, params)) if refs is None else refs
    own = refs.select(F.col("ref_lang_").alias("lang")).where(F.col("lang") != ANY).withColumn("has_own_", F.lit(True))
    keyed = join_small(docs, own, "lang", "left").withColumn("ref_lang_", F.when(F.col("has_own_"), F.col("lang")).otherwise(ANY)).drop("has_own_")
    df = join_small(measure(keyed), refs, "ref_lang_", "left")
    df = df.withColumn("hits_", F.filter("lower_", lambda w: F.array_contains("common_", w)))
    # A word that begins with a letter of ASCII is none; only the others are searched.
    df = df.withColumn("lone_", F.size(F.filter("lower_", lambda w: ~((w >= "a") & (w < "{")) & ~w.rlike(LETTERS))))
    total = F.aggregate("classes_", F.lit(0).cast("long"), lambda a, x: a + x)
    class_p = F.transform("classes_", lambda c: c / total)
    word_p = F.concat(F.transform("common_", lambda c: (F.size("hits_") - F.size(F.array_remove("hits_", c))) / F.col("n_words")), F.array(F.col("lone_") / F.col("n_words"), (F.col("n_words") - F.size("hits_") - F.col("lone_")) / F.col("n_words")))
    compared = F.col("common_").isNotNull() & (F.col("n_words") >= params.min_compared_words) & (F.col("word_chars") >= params.min_chars)
    df = df.withColumn("class_distance", F.when(compared, _js_distance(class_p, F.col("class_ref_")))).withColumn("word_distance", F.when(compared, _js_distance(word_p, F.col("word_ref_"))))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    odd = F.coalesce((F.col("class_distance") > params.max_class_distance) | (F.col("word_distance") > params.max_word_distance), F.lit(False))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)
    return df.select(*map(quoted, docs.columns), *(_fenced(df, c).alias(c) for c in ADDED))


def kept_documents(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows that pass, with the columns that came in (whatever their names)."""
    plain, restored = shielded(docs, ("text", "lang"))
    return apply_rules(plain, params).where("kept").select(*restored)
