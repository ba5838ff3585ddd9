"""Personal data: base patterns, and candidates chosen by gradient-boosted trees.

Everything runs as DataFrame expressions. Regular expressions propose spans of a document: four base kinds
whose validated matches always count, and high-recall generators whose proposals may overlap them. Boosted
trees score a proposal from its format and its surroundings. They are fitted on proposals whose format
settles the matter (valid addresses and numbers against numbers that fail their check), counted by feature
vector over all documents; the score from which a generator's proposals are taken is calibrated on a fold
of documents that the trees did not see.

The patterns are equal to the plain ones given with them, but written without nested repetition and with
look-behind at the start of a run, so that time is linear and no recursion runs deep on long texts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statfold.session import cut_lineage

KINDS = ["email", "ip", "card", "phone", "contact", "number", "secret"]  # the order in which spans are listed
BASE = KINDS[:4]
TREES, DEPTH = 12, 3
PRECISION = 0.98      # of the calibration fold's decided proposals at or above the threshold
FOLDS = 4             # one of them calibrates
_CONTEXT = 24         # characters before a match that are looked at

_DOT, _OTHER = "\ue000", "\ue001"  # stands for an inner separator; what stood in its place before

# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ over text in which dots between label characters are _DOT
_EMAIL = (rf"(?:\G|(?<![A-Za-z0-9._%+{_DOT}-]))[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++")
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ over text in which a blank or hyphen between digits is _DOT
_CARD = rf"[0-9][0-9{_DOT}]++"
# \+[0-9][\x20().0-9-]+[0-9]
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# proposals only
_CONTACT = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++"
            r"(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++")
_NUMBER = r"(?<![0-9A-Za-z.+])[(]?[0-9][0-9 ().-]{5,30}[0-9](?![0-9A-Za-z])"
_SECRET = (r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,2}[=:]\s{0,2}[\x22']?[A-Za-z0-9_./+=-]{6,}+)"
           r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b")
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORDS = r"(?i)(?:card|visa|master|credit|phone|tel|call|fax|mobile|mail|contact|ip|host|address|password|passwd|secret|token|key|login)\W*$"

FEATURES = ["f_gen", "f_digits", "f_plus", "f_paren", "f_quad", "f_luhn", "f_mix", "f_prev", "f_next", "f_word",
            "f_seps", "f_at"]


def _found(kind: str, text: Column, pattern: str, when: Column) -> Column:
    """Matches of a pattern in order: kind, number, characters since the last one, match, what is around it."""
    none = F.array().cast("array<string>")
    got = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    rest = F.transform(F.when(when, F.split(text, pattern, -1)).otherwise(none),
                       lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(_CONTEXT)).alias("tail"),
                                          F.substring(p, 1, 1).alias("head")))
    # what stands before and after each match, side by side
    sides = F.arrays_zip(rest.alias("b"), F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))).alias("a"), got.alias("m"))
    return F.transform(F.filter(sides, lambda x: x["m"].isNotNull()),
                       lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["b"]["n"].alias("gap"),
                                             x["m"].alias("m"), x["b"]["tail"].alias("prev"), x["a"]["head"].alias("next")))


def luhn(digits: Column) -> Column:
    """True for digit strings with a valid check digit."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match of any pattern, with its span and whether its format is valid; one row of nulls in
    the match's columns for a document without any. ``uid`` numbers the input rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"),
                       F.translate(text, _DOT, _OTHER).alias("t"))
    digit, at = F.col("t").rlike("[0-9]"), F.contains("t", F.lit("@"))
    rows = rows.select("id", "uid", "t", digit.alias("d"), at.alias("e"),
                       F.when(digit, F.regexp_replace("t", r"(?<=[0-9])[ -](?=[0-9])", _DOT)).alias("tc"),
                       F.when(at, F.regexp_replace("t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)).alias("te"))
    spelled = F.col("e") | F.col("t").rlike(r"[\[(](?:at|dot)[\])]")
    named = F.col("d") | F.contains("t", F.lit("=")) | F.contains("t", F.lit(":"))
    every = F.concat(
        _found("email", F.col("te"), _EMAIL, F.col("e")), _found("ip", F.col("t"), _IP, F.col("d")),
        _found("card", F.col("tc"), _CARD, F.col("d")), _found("phone", F.col("t"), _PHONE, F.col("d")),
        _found("contact", F.col("t"), _CONTACT, spelled), _found("number", F.col("t"), _NUMBER, F.col("d")),
        _found("secret", F.col("t"), _SECRET, named))
    out = rows.select("id", "uid", F.explode_outer(every).alias("x")).select("id", "uid", "x.*")
    end = F.sum(F.col("gap") + F.length("m")).over(
        Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length("digits")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    out = out.withColumn("digits", digits).withColumn("name", kind).withColumn(
        "luhn", F.when(n.between(13, 19), luhn(F.col("digits"))).otherwise(False))
    four = F.col("m").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    base = (F.when(F.col("name") == "email", F.lit(True)).when(F.col("name") == "ip", four)
            .when(F.col("name") == "card", F.col("luhn")).when(F.col("name") == "phone", n.between(9, 15)).otherwise(False))
    return out.withColumn("base", base).withColumn("quad", four)


def _features(rows: DataFrame) -> DataFrame:
    """Small whole numbers that describe a proposal's format and surroundings, and the label its format gives it.

    Label: 1 for valid formats; 0 for addresses with a part above 255, 13 to 19 digits with a wrong check
    digit, and numbers too short or long for any kind; null where the format does not tell.
    """
    m, n = F.col("m"), F.length("digits")
    rest = F.regexp_replace("m", r"^(?i:[a-z _-]{3,12}\s{0,2}[=:])", "")
    side = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s$"), 0).when(c.rlike(r"^\w$"), 2).otherwise(1)
    seps = F.length(F.regexp_replace("m", "[^ ().-]", ""))
    secret = F.col("name") == "secret"
    rows = rows.withColumns({
        "f_gen": F.col("kind"),
        "f_digits": F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4),
        "f_plus": m.startswith("+").cast("int"), "f_paren": F.contains(m, F.lit("(")).cast("int"),
        "f_quad": F.col("quad").cast("int"), "f_luhn": F.col("luhn").cast("int"),
        "f_mix": F.when(~rest.rlike("[A-Za-z]"), 0).when(~rest.rlike("[0-9]"), 1).otherwise(2),
        "f_prev": side(F.right("prev", F.lit(1))), "f_next": side(F.coalesce("next", F.lit(""))),
        "f_word": F.col("prev").rlike(_WORDS).cast("int"),
        "f_seps": F.when(seps == 0, 0).when(seps < 3, 1).when(seps < 6, 2).otherwise(3),
        "f_at": F.contains(m, F.lit("@")).cast("int")})
    bad = ((F.col("name") == "ip") & ~F.col("quad")) | ((n.between(13, 19)) & ~F.col("luhn") & ~secret) | (
        (n < 7) & F.col("name").isin("number", "card")) | ((n > 19) & ~secret) | (secret & ~rest.rlike("[0-9]"))
    good = F.col("base") | F.col("quad") | (F.col("luhn") & F.col("name").isin("number")) | (
        secret & (F.col("f_mix") == 2)) | ((F.col("name") == "contact") & (F.col("f_at") == 1))
    return rows.withColumn("label", F.when(good, 1.0).when(bad, 0.0))


def _thresholds(table: DataFrame) -> tuple[object, dict[int, float]]:
    """(fitted trees, threshold of each generator) from counted feature vectors; (None, {}) if one label is missing."""
    known = table.filter("label is not null")
    got = {x[0] for x in known.filter("fold > 0").select("label").distinct().collect()}
    if got != {0.0, 1.0}:
        return None, {}
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
    # in one order: sums of floats, and so the splits, are then the same in every run
    model = trees.fit(vector.transform(known.filter("fold > 0")).coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    scored = model.transform(vector.transform(known.filter("fold = 0"))).select(
        "f_gen", "label", "weight", F.round(vector_to_array("probability")[1], 6).alias("p"))
    # one row for each feature vector: their number is bounded by the features' values
    rows = sorted(scored.groupBy("f_gen", "p").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label"))
                                                   .alias("good")).collect(), key=lambda r: -r.p)
    least: dict[int, float] = {}
    for gen in {r.f_gen for r in rows}:
        n = good = 0.0
        for r in (r for r in rows if r.f_gen == gen):
            n, good = n + r.n, good + r.good
            if good >= PRECISION * n:
                least[gen] = max(0.5, r.p)
    return model, least


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, uid, spans), one per input row.

    ``spans`` lists kind, start, end (code points, end exclusive), base and score of every span taken, sorted
    by kind and start: all valid base matches (score 1 or the trees'), and of the generators' proposals those
    at or above their generator's threshold, less those inside a base match. Null and empty texts have none;
    repeated rows and null ids are ordinary; extra columns are ignored. Without proposals of both labels
    nothing is fitted and the base matches are the result.
    """
    rows = cut_lineage(_features(proposals(docs, id_col, text_col)).drop("prev", "next", "digits"))
    table = (rows.filter("kind is not null").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)))
             .withColumn("fold", F.when(F.col("fold") == 0, 0).otherwise(1))
             .groupBy(*FEATURES, "label", "fold").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    table = cut_lineage(table)
    model, least = _thresholds(table)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table.select(*FEATURES).distinct())
        scores = model.transform(vectors).select(*FEATURES, F.round(vector_to_array("probability")[1], 6).alias("score"))
        scored = rows.join(scores, FEATURES, "left")
    over = F.lit(False)
    for gen, p in sorted(least.items()):
        if gen >= len(BASE):
            over = over | ((F.col("kind") == gen) & (F.col("score") >= p))
    # a proposal inside a valid base match says nothing new
    until = Window.partitionBy("uid").orderBy("start", F.desc("end"), F.desc("base"), "kind").rowsBetween(
        Window.unboundedPreceding, 0)
    scored = scored.withColumn("inside", F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(until)
                                                    >= F.col("end"), F.lit(False)))
    taken = F.when(F.col("base") | (over & ~F.col("inside")), F.struct(
        "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base",
        F.coalesce("score", F.lit(1.0)).alias("score")))
    every = scored.groupBy("id", "uid").agg(F.array_sort(F.collect_list(taken)).alias("x"))
    named = F.transform("x", lambda x: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"),
        x["end"].alias("end"), x["base"].alias("base"), x["score"].alias("score")))
    return every.select(F.col("id").alias(id_col), "uid", named.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first to start counts."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"])))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(order, first, lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["),
                 x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))).otherwise(
        F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))))
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))
