"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document gets two histograms: its characters by class, and its words over the common words of its language. Each is
held against the language's reference by Jensen-Shannon distance. References are the sums over all typical documents of
the language, smoothed by those of all languages together, so that a rare language is judged like any other; short
documents, whose histograms are noise, are not judged by distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import let, read_table, stored, words_of

#: Common function words by language; the last list serves any other language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
    "": ["the", "de", "la", "and", "der", "en", "of", "die", "le", "und", "que", "to", "et", "in", "a", "un"],
}
#: Languages up to this number (a hundred numbers each) are broadcast with their references.
BROADCAST_LANGUAGES = 10_000
CLASSES = ("upper", "digit", "stop", "inner", "symbol", "space", "accent", "other")
PARAMS = {
    "min_words": 50,  # the base rule's floor
    "char_min": 200,  # code points below which the character histogram is not judged
    "word_min": 80,  # words below which the common-word histogram is not judged
    "typical_chars": 0.25,  # documents farther than this from the sum of all are left out of the references
    "typical_words": 0.3,
    "char_limit": 0.12,  # largest Jensen-Shannon distance (0 to 1) of the character classes, plus char_noise / sqrt(code points)
    "char_noise": 1.6,
    "word_limit": 0.1,  # and of the common words, plus word_noise / sqrt(words)
    "word_noise": 2.0,
    "prior_chars": 60_000,  # code points and words that all languages together add to the reference of each
    "prior_words": 10_000,
}


#: What most of a text consists of: without it the classes are counted on a fraction of the text.
_BULK = r"[a-z\x20\x09-\x0D]++"


def parts_of(rows: DataFrame) -> DataFrame:
    """``rows`` (with _text) and what the counts are taken from: _words, _letters (lower-case runs of letters), _rest (the
    text without lower-case ASCII letters and white space) and _word_chars."""
    text = F.col("_text")
    rows = rows.withColumns({"_words": words_of(text), "_letters": F.split(F.lower(text), r"[^\p{L}]+"), "_rest": F.regexp_replace(text, F.lit(_BULK), F.lit(""))})
    return rows.withColumn("_word_chars", F.length(F.array_join("_words", "")).cast("long"))


def base_counts() -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words over the columns of :func:`parts_of`."""
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.col("_word_chars"),
        "n_symbols": F.regexp_count("_rest", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.when(F.instr("_text", "\n") == 0, F.lit(0).cast("long")).otherwise(let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
    }


def repeated_words(words: Column, hash_mask: int = -1) -> Column:
    """How many words lie in a window of three that occurs twice or more.

    A window becomes one long: its place in as many low bits as places need, its hash in all others, so that a sort of
    plain longs brings equal windows together. Neighbours with equal hashes are compared word by word; one that differs
    from both, as hashes of different windows may be equal, is compared with every window of its hash. The places of the
    repeats, sorted, cover three words each, less what the next one covers as well. No step looks at pairs of windows.
    ``hash_mask`` keeps some bits of the hashes only, to test collisions.
    """

    def windows(w: Column, low: Column, high: Column) -> Column:
        kept = high if hash_mask == -1 else high.bitwiseAND(F.lit(hash_mask).cast("long"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(kept).bitwiseOR(i.cast("long"))))

    # past either end an index gives null, which is no match
    def alike(s: Column, high: Column) -> Column:
        near = lambda x, y: x.bitwiseXOR(y).bitwiseAND(high) == 0
        return F.filter(s, lambda x, k: near(x, F.get(s, k + 1)) | near(x, F.get(s, k - 1)))

    def places(w: Column, low: Column, high: Column, s: Column) -> Column:
        at = lambda v, k: F.get(w, v.bitwiseAND(low).cast("int") + k)
        same = lambda x, y: (x.bitwiseXOR(y).bitwiseAND(high) == 0) & (at(x, 0) == at(y, 0)) & (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2))
        beside = lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))
        again = F.filter(s, lambda x, k: beside(x, k) | F.exists(s, lambda y: (x != y) & same(x, y)))
        return F.sort_array(F.transform(again, lambda x: x.bitwiseAND(low).cast("int")))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda n, g: n + g)

    low = (F.pow(F.lit(2.0), F.length(F.bin(F.size(words)))) - 1).cast("long")
    both = F.struct(low.alias("low"), F.bitwise_not(low).alias("high"))
    found = let(both, lambda b: let(let(let(windows(words, b["low"], b["high"]), lambda s: alike(s, b["high"])), lambda s: places(words, b["low"], b["high"], s)), covered))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found)


def class_counts() -> Column:
    """Code points by class, in the order of CLASSES. ``accent`` is whatever is neither ASCII nor a Latin-1 capital."""
    rest, n_chars = F.col("_rest"), F.length("_text")
    n = {
        "upper": F.regexp_count(rest, F.lit(r"[A-Z\u00C0-\u00DE]")),
        "digit": F.regexp_count(rest, F.lit(r"[0-9]")),
        "stop": F.regexp_count(rest, F.lit(r"[.!?]")),
        "inner": F.regexp_count(rest, F.lit(r"[,;:'\"()\-]")),
        "symbol": F.regexp_count(rest, F.lit(r"[#*$%&|<>@+=/\\_~^`\[\]{}\x00-\x08\x0E-\x1F\x7F]")),
        "space": n_chars - F.col("_word_chars"),
        "accent": F.regexp_count(rest, F.lit(r"[^\x00-\x7F\u00C0-\u00DE]")),
    }
    known = [n[c].cast("long") for c in CLASSES[:-1]]
    return F.array(*known, F.greatest(n_chars - sum(known[1:], known[0]), F.lit(0)).cast("long"))


def common_counts(lang: Column, common: dict[str, list[str]]) -> Column:
    """How often each common word of the language stands in the text, ignoring case, then how many words are left."""

    def counts(listed: list[str]) -> Column:
        hits = F.filter("_letters", lambda w: w.isin(listed))
        times = lambda x, c: F.size(F.filter(x, lambda w: w == c)).cast("long")
        return let(hits, lambda x: F.concat(F.array(*[times(x, c) for c in listed]), F.array(F.greatest(F.size("_words") - F.size(x), F.lit(0)).cast("long"))))

    return reduce(lambda out, k: out.when(lang == k, counts(common[k])), [k for k in common if k], F).otherwise(counts(common[""]))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, 0 to 1, of two histograms of counts; null where one of them is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda n, v: n + v.cast("double"))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def spread(n: Column) -> Column:
        parts = F.zip_with(p, q, lambda a, b: let(F.struct((a / n["p"]).alias("a"), (b / n["q"]).alias("b")), lambda x: term(x["a"], (x["a"] + x["b"]) / 2) + term(x["b"], (x["a"] + x["b"]) / 2)))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda n, v: n + v) / 2, F.lit(0.0)))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda n: F.when((n["p"] > 0) & (n["q"] > 0), spread(n)))


def _sums(name: str, size: int) -> list[Column]:
    return [F.sum(F.get(F.col(name), F.lit(k))).alias(f"{name}_{k}") for k in range(size)]


def references(hists: DataFrame, bins: int, p: dict) -> DataFrame:
    """(_ref, ref_chars, ref_words): per language the summed histograms of all its documents.

    To the sums of each language those of all languages together are added, scaled to ``prior_chars`` code points and
    ``prior_words`` words: to a language of many words they are nothing, for one of few they are the reference. The common
    words of different languages meet there by their place in the lists, which is their rank. A null language is one of its own
    (empty name). The row with a null name sums everything.
    """
    sums = [*_sums("chars", len(CLASSES)), *_sums("common", bins)]
    pack = lambda name, size: F.array(*[F.col(f"{name}_{k}") for k in range(size)])
    each = stored(hists.groupBy("_lang").agg(*sums).select("_lang", pack("chars", len(CLASSES)).alias("chars"), pack("common", bins).alias("common")), "sums")
    every = each.agg(*_sums("chars", len(CLASSES)), *_sums("common", bins)).select(pack("chars", len(CLASSES)).alias("all_chars"), pack("common", bins).alias("all_common")).first()  # some 25 numbers

    def smooth(own: Column, total: list, mass: float) -> Column:
        n = float(sum(x or 0 for x in total)) or 1.0
        prior = F.array(*[F.lit(float(x or 0) / n * mass) for x in total])
        return F.zip_with(own, prior, lambda a, b: a.cast("double") + b)

    whole = [F.array(*[F.lit(float(x or 0)) for x in every[k]]) for k in ("all_chars", "all_common")]
    known = each.select(F.col("_lang").alias("_ref"), smooth(F.col("chars"), every["all_chars"], p["prior_chars"]).alias("ref_chars"), smooth(F.col("common"), every["all_common"], p["prior_words"]).alias("ref_words"))
    return known.unionByName(hists.sparkSession.range(1).select(F.lit(None).cast("string").alias("_ref"), whole[0].alias("ref_chars"), whole[1].alias("ref_words")))


def distances(hists: DataFrame, refs: DataFrame) -> DataFrame:
    """``hists`` with js_chars and js_words, the distances from the references of each row's language; a language without
    a reference is held against that of all."""
    refs = stored(refs, "references")
    own = refs.where("_ref IS NOT NULL")
    if own.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:  # else one language's rows meet in the tasks of a join
        own = F.broadcast(own)
    every = refs.where("_ref IS NULL").first()  # some 25 numbers
    chars, words = (F.coalesce(F.col(c), F.array(*[F.lit(x) for x in every[c]])) for c in ("ref_chars", "ref_words"))
    joined = hists.join(own, F.col("_lang") == F.col("_ref"), "left")
    return joined.select(*hists.columns, js_distance(F.col("chars"), chars).alias("js_chars"), js_distance(F.col("common"), words).alias("js_words"))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(docs: DataFrame, carry: list[Column], params: dict | None, common: dict[str, list[str]] | None) -> DataFrame:
    """A row for each row of ``docs``: the columns ``carry``, the counts, base_failed, kept, js_chars and js_words."""
    p = PARAMS | (params or {})
    common = common or COMMON
    bins = len(next(iter(common.values()))) + 1
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    kept = [f"_carried_{k}" for k in range(len(carry))]
    rows = parts_of(docs.select(*[c.alias(k) for k, c in zip(kept, carry, strict=True)], lang.alias("_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")))
    hists = rows.select(*kept, "_lang", *[c.alias(k) for k, c in base_counts().items()], class_counts().alias("chars"), common_counts(F.col("_lang"), common).alias("common"), F.length("_text").alias("n_chars"))
    hists = stored(hists, "quality")  # some forty numbers a document beside what is carried: the texts are split once
    numbers = hists.select("_lang", "n_words", "chars", "common")
    first = distances(numbers.where("n_words > 0"), references(numbers.where("n_words > 0"), bins, p))
    # documents far from everything else would pull the references towards themselves
    typical = first.where((F.col("js_chars") <= p["typical_chars"]) & F.coalesce(F.col("js_words") <= p["typical_words"], F.lit(True)))
    joined = distances(hists, references(typical.select(numbers.columns), bins, p))
    base_failed = (F.col("n_words") < p["min_words"]) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far_chars = (F.col("n_chars") >= p["char_min"]) & (F.col("js_chars") > p["char_limit"] + p["char_noise"] / F.sqrt("n_chars"))
    far_words = (F.col("n_words") >= p["word_min"]) & (F.col("js_words") > p["word_limit"] + p["word_noise"] / F.sqrt("n_words"))
    no = F.lit(False)
    return joined.select(*kept, *_COUNTS, base_failed.alias("base_failed"), (~base_failed & ~F.coalesce(far_chars, no) & ~F.coalesce(far_words, no)).alias("kept"), "js_chars", "js_words")


def judge(docs: DataFrame, params: dict | None = None, common: dict[str, list[str]] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, counts, base_failed, kept, js_chars, js_words), a row for each row of ``docs``.

    Null text is empty: it has no words and fails the base rule. Repeated rows each get a row. A null language is a
    language of its own. Extra columns are ignored. Without rows there are none.
    """
    found = _judged(docs, [F.col(id_col).cast("long")], params, common)
    return found.select(F.col("_carried_0").alias("doc_id"), *_COUNTS, "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"))


def keep_good(docs: DataFrame, params: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns. Each row has a verdict of its own, whatever its doc_id
    is, and rows are carried beside it: no text is shuffled."""
    kept = _judged(docs, [F.struct(*docs.columns)], params, None).where("kept")
    return kept.select(*[F.col("_carried_0").getField(c).alias(c) for c in docs.columns])


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The query in SQL: the same counts, references and distances, step by step."""
    bins = len(COMMON[""]) + 1
    n_classes = len(CLASSES)
    p = PARAMS
    langs = [k for k in COMMON if k]
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    upper, digit, stop = count(r"[A-Z\x{C0}-\x{DE}]"), count("[0-9]"), count("[.!?]")
    inner, symbol, accent = count(r"[,;:''\"()\-]"), count(r"[#*$%&|<>@+=/\\_~^`\[\]{}\x00-\x08\x0E-\x1F\x7F]"), count(r"[^\x00-\x7F\x{C0}-\x{DE}]")
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN {COMMON[k]!r}" for k in langs) + f" ELSE {COMMON['']!r} END"
    total = lambda x: f"list_sum({x})"
    term = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0.0 END"

    def distance(own: str, ref: str, size: int) -> str:
        a, b = f"({own}[i] / {total(own)})", f"({ref}[i] / {total(ref)})"
        m = f"({a} + {b}) / 2"
        spread = f"sqrt(greatest(list_sum(list_transform(range(1, {size + 1}), lambda i: {term(a, m)} + {term(b, m)})) / 2, 0.0))"
        return f"CASE WHEN {total(own)} > 0 AND {total(ref)} > 0 THEN {spread} END"

    def refs(name: str, rows: str) -> str:
        sums = lambda c, size: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(size)) + "]::DOUBLE[]"
        smooth = lambda own, every, mass, size: f"list_transform(range(1, {size + 1}), lambda i: o.{own}[i] + CASE WHEN {total('w.' + every)} > 0 THEN w.{every}[i] / {total('w.' + every)} ELSE 0.0 END * {mass})"
        return (
            f"{name}_w AS (SELECT {sums('chars', n_classes)} AS chars, {sums('common', bins)} AS common FROM {rows}), "
            f"{name}_o AS (SELECT lang, {sums('chars', n_classes)} AS chars, {sums('common', bins)} AS common FROM {rows} GROUP BY lang), "
            f"{name} AS (SELECT lang, {smooth('chars', 'chars', p['prior_chars'], n_classes)} AS chars, {smooth('common', 'common', p['prior_words'], bins)} AS common FROM {name}_o o, {name}_w w)"
        )

    def held(name: str, rows: str, ref: str) -> str:
        return (
            f"{name}_r AS (SELECT h.*, coalesce(r.chars, w.chars) AS ref_chars, coalesce(r.common, w.common) AS ref_common FROM {rows} h LEFT JOIN {ref} r USING (lang), {ref}_w w), "
            f"{name} AS (SELECT * EXCLUDE (ref_chars, ref_common), {distance('chars', 'ref_chars', n_classes)} AS js_chars, {distance('common', 'ref_common', bins)} AS js_words FROM {name}_r)"
        )

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, regexp_split_to_array(lower(t), '[^\p{{L}}]+') AS runs,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM tri),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM keyed, range(3) AS o(k) WHERE n > 1 GROUP BY rid),
listed AS (SELECT *, {listed} AS known FROM w),
base AS (SELECT rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({count('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars,
    [{upper}, {digit}, {stop}, {inner}, {symbol}, length(t) - length(array_to_string(ws, '')), {accent}] AS seven,
    list_transform(known, lambda c: len(list_filter(runs, lambda x: x = c))) AS hits
    FROM listed LEFT JOIN covered c USING (rid)),
hists AS (SELECT * EXCLUDE (seven, hits), list_append(seven, greatest(n_chars - list_sum(seven), 0))::DOUBLE[] AS chars, list_append(hits, greatest(n_words - list_sum(hits), 0))::DOUBLE[] AS common FROM base),
worded AS (SELECT * FROM hists WHERE n_words > 0),
{refs('ref1', 'worded')},
{held('first', 'worded', 'ref1')},
typical AS (SELECT * FROM first WHERE js_chars <= {p['typical_chars']} AND coalesce(js_words <= {p['typical_words']}, TRUE)),
{refs('ref2', 'typical')},
{held('judged', 'hists', 'ref2')},
failed AS (SELECT *, n_words < {p['min_words']} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(n_chars >= {p['char_min']} AND js_chars > {p['char_limit']} + {p['char_noise']} / sqrt(n_chars), FALSE)
        AND NOT coalesce(n_words >= {p['word_min']} AND js_words > {p['word_limit']} + {p['word_noise']} / sqrt(n_words), FALSE) AS kept,
    round(js_chars, 6) AS js_chars, round(js_words, 6) AS js_words
FROM failed
"""


OP3_SQL = _sql()
