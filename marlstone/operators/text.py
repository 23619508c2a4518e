"""Text checks: redaction, label leaks, mentions, similarity, grounding.

Label forms are a dimension of some words and phrases.  A text is cut into words
once; those that are forms, or begin one, are found in the row by a set of
literals, and only they leave it (:func:`occurrences`).  No text is ever paired
with every form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marlstone.functions.normal import once
from marlstone.plans.registry import query
from marlstone.sources.views import table

#: label -> forms: fixed values.
FORMS = {"en": ("that", "with", "this", "from", "eriner thanea"), "fr": ("pour", "dans", "avec", "elle", "en enmentai"), "de": ("sich", "nicht", "eine", "stteen erachtz"), "es": ("para", "ci nmente")}
_PAIRS = [(lab, f) for lab, fs in FORMS.items() for f in fs]
_LONGEST = sorted((f for _, f in _PAIRS), key=lambda f: (-len(f), f))
_ALT = "|".join(_LONGEST)
_FORMS_SQL = "forms(label, form) AS (VALUES " + ", ".join(f"('{a}', '{f}')" for a, f in _PAIRS) + ")"
NGRAM = 4


def forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PAIRS, "label string, form string")


def scrubbed(text: Column) -> Column:
    """Every label form, longest first, between non-letters, redacted."""
    forms_ = _ALT.replace(" ", "[^A-Za-z]")
    return F.regexp_replace(text, f"(?i)(?<![A-Za-z])(?:{forms_})(?![A-Za-z])", "[redacted]")


@query(rf"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[^A-Za-z]', '  ', 'g'), '(?i)(^| )({_ALT.replace(" ", "  ")})( |$)'))::BIGINT AS n_redacted FROM documents")
def scrub(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", scrubbed(F.col("text")).alias("t"))
    return d.select("doc_id", ((F.length("t") - F.length(F.replace("t", F.lit("[redacted]"), F.lit("")))) / 10).cast("long").alias("n_redacted"))


#: Forms that may be held as literals.
MOST_FORMS = 50_000


def form_list(forms_: DataFrame) -> list[str]:
    """The distinct forms of a dimension, once it is known to be one."""
    rows = forms_.select("form").where("form IS NOT NULL").distinct().limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} forms: that is no dimension")
    return sorted(r.form for r in rows)


def occurrences(text: Column, known: Sequence[str]) -> Column:
    """Every occurrence of the forms (words, or words joined by single spaces)
    in a text, overlapping ones too."""
    sizes: dict[int, list[str]] = {}
    for f in known:
        sizes.setdefault(len(f.split(" ")), []).append(f)

    def found(w: Column) -> Column:
        out = [F.filter(w, lambda x: x.isin(sizes[1]))] if 1 in sizes else []
        for k in sorted(set(sizes) - {1}):
            heads = sorted({f.split(" ")[0] for f in sizes[k]})
            starts = F.filter(F.transform(w, lambda x, i: F.when(x.isin(heads), i)), lambda i: i.isNotNull())
            out.append(F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " ")), lambda x: x.isin(sizes[k])))
        return F.concat(*out) if out else F.array().cast("array<string>")

    # a text that is null has no words
    return once(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != ""), found)


def mentions(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, label, n): whole-word mentions."""
    words = docs.select("doc_id", F.explode(occurrences(F.col("text"), _LONGEST)).alias("form"))
    return words.join(F.broadcast(forms(spark)), "form").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


_WORDS_SQL = r"ws AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN_]+'), lambda x: x <> '') AS ws FROM documents), w AS (SELECT doc_id, lang, unnest(list_concat(ws, [ws[i] || ' ' || ws[i+1] for i in range(1, len(ws))])) AS form FROM ws)"


@query(f"WITH {_FORMS_SQL}, {_WORDS_SQL} SELECT doc_id, label, count(*) AS n FROM w JOIN forms USING (form) GROUP BY 1, 2")
def mention(spark, sf_dir):
    return mentions(table(spark, sf_dir, "documents"), spark)


@query(f"WITH {_FORMS_SQL}, {_WORDS_SQL}, l AS (SELECT doc_id, lang FROM w JOIN forms USING (form) WHERE label = lang GROUP BY 1, 2) SELECT lang, count(*) AS leaking FROM l GROUP BY 1")
def leak_pred(spark, sf_dir):
    """Texts that name their own label, by label."""
    d = table(spark, sf_dir, "documents")
    m = mentions(d, spark).join(d.select("doc_id", F.col("lang").alias("label")), ["doc_id", "label"])
    return m.groupBy(F.col("label").alias("lang")).agg(F.count_distinct("doc_id").alias("leaking"))


@query("SELECT DISTINCT word FROM (SELECT n_name AS word FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT DISTINCT event_type FROM events UNION ALL SELECT DISTINCT l_returnflag FROM lineitem) WHERE word IS NOT NULL")
def vocabulary(spark, sf_dir):
    """The global vocabulary: names, displays, units and values."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("word")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("events", "event_type"), ("lineitem", "l_returnflag"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).where("word IS NOT NULL").distinct()


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def ngrams(s: Column, n: int = NGRAM) -> Column:
    """Distinct character n-grams; a shorter text is its own only one."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of n-grams."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


_SQUASH = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def similar_items(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """(item_id, other, shared, sim): each benchmark item's most similar other
    item.  Grams are joined, so only items that share one are compared."""
    g = table(spark, sf_dir, "benchmark").select("item_id", ngrams(squashed(F.col("text"))).alias("g")).select("item_id", F.size("g").alias("n"), F.explode("g").alias("x"))
    j = g.join(g.toDF("other", "m", "x"), "x").where("item_id != other").groupBy("item_id", "other", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    s = j.withColumn("sim", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    nth = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc(F.round("sim", 9)), "other"))
    return s.withColumn("nth", nth).where(F.col("nth") <= k)


@query(f"WITH s AS (SELECT item_id, {_SQUASH.format('text')} AS s FROM benchmark), g AS (SELECT item_id, list_distinct([s[i:i+3] for i in range(1, greatest(length(s) - 3, 1) + 1)]) AS g FROM s), p AS (SELECT a.item_id, b.item_id AS other, len(list_intersect(a.g, b.g))::DOUBLE AS i, len(a.g) + len(b.g) AS n FROM g a JOIN g b ON a.item_id <> b.item_id), r AS (SELECT *, i / (n - i) AS sim, row_number() OVER (PARTITION BY item_id ORDER BY round(i / (n - i), 9) DESC, other) AS nth FROM p WHERE i > 0) SELECT item_id, other, round(sim, 6) AS sim FROM r WHERE nth = 1")
def leak_sim(spark, sf_dir):
    return similar_items(spark, sf_dir).select("item_id", "other", F.round("sim", 6).alias("sim"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, s): sentences of at least eight characters."""
    s = docs.select("doc_id", F.explode(F.split("text", r"[.;\n]")).alias("s")).select("doc_id", F.trim("s").alias("s"))
    return s.where(F.length("s") >= 8)


@query(f"WITH {_FORMS_SQL}, x AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.;\\n]'))) AS s FROM documents), z AS (SELECT doc_id, {_SQUASH.format('s')} AS s FROM x WHERE length(s) >= 8), w AS (SELECT doc_id, s, unnest(string_split(s, ' ')) AS form FROM z WHERE length(s) <= 24) SELECT label, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM w JOIN forms USING (form) GROUP BY 1")
def leak_sentences(spark, sf_dir):
    """Short sentences that are mostly a label form, by label: the candidates
    of the similarity check, found by their words."""
    z = sentences(table(spark, sf_dir, "documents")).select("doc_id", squashed(F.col("s")).alias("s")).where(F.length("s") <= 24)
    w = z.select("doc_id", F.explode(F.split("s", " ")).alias("form")).join(F.broadcast(forms(spark)), "form")
    return w.groupBy("label").agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("hits"))


SIMILAR, AROUND = 0.55, 30
_FORM_EDGE = r"(?<![\p{L}\p{N}_])"
_FORM_END = r"(?![\p{L}\p{N}_])"


def gram_similarity(a: Column, b: Column) -> Column:
    return similarity(ngrams(a), ngrams(b))


def leaks(docs: DataFrame, forms_: DataFrame, like: Callable[[Column, Column], Column] = gram_similarity, least: float = SIMILAR) -> DataFrame:
    """(doc_id, label, kind, form, sim, excerpt) of texts (doc_id, text, label)
    that give their label away: by a form as whole words ("word"), or else by a
    sentence that is like a form ("similar": the most similar one).

    ``like`` is any similarity of two squashed texts; the default compares
    four-character grams.  Sentences so long that the default cannot reach
    ``least`` are passed over when it is the one in use.
    """
    d = docs.select("doc_id", "label", "text")
    named = d.select("doc_id", "label", "text", F.explode(occurrences(F.col("text"), form_list(forms_))).alias("form")).join(F.broadcast(forms_), ["label", "form"])
    spot = F.regexp_instr(F.lower("text"), F.concat(F.lit(_FORM_EDGE), F.replace("form", F.lit(" "), F.lit(r"[^\p{L}\p{N}_]+")), F.lit(_FORM_END)))
    words = named.groupBy("doc_id", "label").agg(F.min(F.struct(spot.alias("at"), "form")).alias("m"), F.first("text").alias("text"))
    cut = F.substr("text", F.greatest(F.col("m.at") - AROUND, F.lit(1)), F.length("m.form") + 2 * AROUND)
    words = words.select("doc_id", "label", F.lit("word").alias("kind"), "m.form", F.lit(1.0).alias("sim"), cut.alias("excerpt"))
    rest = d.join(words.select("doc_id"), "doc_id", "left_anti")
    s = rest.select("doc_id", "label", F.explode(F.split("text", r"[.;\n]")).alias("s")).select("doc_id", "label", F.trim("s").alias("s")).where(F.length("s") >= 8)
    s = s.withColumn("q", squashed(F.col("s")))
    if like is gram_similarity:
        longest = forms_.agg(F.max(F.length("form"))).first()[0] or 0
        s = s.where(F.length("q") <= (longest + NGRAM) / least + NGRAM)
    near = s.join(F.broadcast(forms_), "label").withColumn("sim", like(F.col("q"), squashed(F.col("form")))).where(F.col("sim") >= least)
    best = near.groupBy("doc_id", "label").agg(F.min(F.struct((-F.round("sim", 9)).alias("o"), "form", "s")).alias("m"))
    similar = best.select("doc_id", "label", F.lit("similar").alias("kind"), "m.form", (-F.col("m.o")).alias("sim"), F.col("m.s").alias("excerpt"))
    return words.unionByName(similar)


@query(rf"""WITH {_FORMS_SQL}, {_WORDS_SQL}, h AS (SELECT DISTINCT doc_id, label, form FROM w JOIN forms USING (form) WHERE label = lang),
wd AS (SELECT doc_id, label, 'word' AS kind, 1.0 AS sim FROM h GROUP BY 1, 2),
x AS (SELECT doc_id, lang AS label, trim(unnest(regexp_split_to_array(text, '[.;
]'))) AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM wd)),
z AS (SELECT doc_id, label, {_SQUASH.format('s')} AS q FROM x WHERE length(s) >= 8),
g AS (SELECT doc_id, label, q, list_distinct([q[i:i+3] for i in range(1, greatest(length(q) - 3, 1) + 1)]) AS g FROM z),
f AS (SELECT label, form, list_distinct([form[i:i+3] for i in range(1, greatest(length(form) - 3, 1) + 1)]) AS fg FROM forms),
p AS (SELECT doc_id, label, len(list_intersect(g, fg))::DOUBLE / (len(g) + len(fg) - len(list_intersect(g, fg))) AS sim FROM g JOIN f USING (label))
SELECT * FROM wd UNION ALL SELECT doc_id, label, 'similar', round(max(sim), 6) FROM p WHERE sim >= {SIMILAR} GROUP BY 1, 2""")
def leak_detect(spark, sf_dir):
    """Texts that give their language's forms away, by words or by likeness."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return leaks(d, forms(spark)).select("doc_id", "label", "kind", F.round("sim", 6).alias("sim"))


@query("WITH n AS (SELECT n_nationkey AS key, lower(n_name) AS d FROM nation), f AS (SELECT key, unnest(list_concat([d, replace(d, ' ', '_')], list_filter(string_split(d, ' '), lambda x: length(x) >= 5))) AS form FROM n) SELECT key, string_agg(DISTINCT form, ',' ORDER BY form) AS forms FROM f GROUP BY 1")
def label_forms(spark, sf_dir):
    """Forms of a label: its display, its slug, and its words of five letters."""
    d = F.lower("n_name")
    every = F.concat(F.array(d, F.replace(d, F.lit(" "), F.lit("_"))), F.filter(F.split(d, " "), lambda x: F.length(x) >= 5))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("forms"))


@query(f"WITH {_FORMS_SQL}, c AS (SELECT a.form AS short, b.form AS long FROM forms a, forms b WHERE a.form <> b.form AND contains(b.form, a.form)), n AS (SELECT a.n_name AS short, b.n_name AS long FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND contains(' ' || b.n_name || ' ', ' ' || a.n_name || ' ')) SELECT short, long FROM c UNION ALL SELECT short, long FROM n")
def subphrases(spark, sf_dir):
    """Forms inside other forms and names that are whole phrases of others."""
    f, n = forms(spark).select("form"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = f.toDF("short").join(F.broadcast(f.toDF("long")), (F.col("short") != F.col("long")) & F.col("long").contains(F.col("short")))  # dimensions
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    p = n.toDF("ka", "short").join(F.broadcast(n.toDF("kb", "long")), (F.col("ka") != F.col("kb")) & pad(F.col("long")).contains(pad(F.col("short"))))
    return c.unionByName(p.select("short", "long"))


PROB_NEAR, TOLERANCE, MIN_CHARS = 60, 0.02, 60


def grounding_findings(turns: DataFrame, beliefs: DataFrame, forms_: DataFrame, top_n: int = 3) -> DataFrame:
    """(turn_id, label, kind) of labels named in ``turns`` (turn_id, text) that
    the belief (turn_id, label, p, rank) does not rank among its first, or that
    are named somewhere without a number near that is their probability."""
    words = turns.select("turn_id", "text", F.explode(F.array_distinct(occurrences(F.col("text"), form_list(forms_)))).alias("form"))
    j = words.join(F.broadcast(forms_), "form").join(beliefs, ["turn_id", "label"], "left")
    # every mention with what follows it: a look-ahead finds those that overlap
    after = F.concat(F.lit("(?s)(?=" + _FORM_EDGE + "("), F.replace("form", F.lit(" "), F.lit(r"[^\p{L}\p{N}_]+")), F.lit(_FORM_END + f".{{0,{PROB_NEAR}}}))"))
    spots = F.regexp_extract_all(F.lower("text"), after, F.lit(1))
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d*\.\d+"), F.lit(0)), lambda x: x.cast("double"))
    near = lambda t: F.exists(numbers(t), lambda x: F.abs(x - F.coalesce("p", F.lit(0.0))) <= TOLERANCE + 1e-9)
    kind = F.when(F.coalesce(F.col("rank") > top_n, F.lit(True)), "unearned_mention").when(~F.forall(spots, near), "ungrounded_assertion")
    return j.select("turn_id", "label", kind.alias("kind")).where("kind IS NOT NULL").distinct()


def traces_rejected(turns: DataFrame, findings: DataFrame, least: int = 60) -> DataFrame:
    """(turn_id, reasons) of turns (turn_id, text, concludes) with findings or
    with too little reasoning; what concludes may be short."""
    f = findings.groupBy("turn_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    j = turns.join(f, "turn_id", "left")
    stub = F.when(~F.col("concludes") & (F.coalesce(F.length("text"), F.lit(0)) < least), F.array(F.lit("stub_reasoning")))
    none = F.array().cast("array<string>")
    return j.select("turn_id", F.concat(F.coalesce(stub, none), F.coalesce("kinds", none)).alias("reasons")).where(F.size("reasons") > 0)


def _word_beliefs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts as turns, and a belief of each over labels: its share of mentions."""
    d = table(spark, sf_dir, "documents")
    m = mentions(d, spark)
    w = W.partitionBy("doc_id")
    p = (F.col("n") / F.sum("n").over(w)).alias("p")
    b = m.select(F.col("doc_id").alias("turn_id"), "label", p, F.row_number().over(w.orderBy(F.desc("n"), "label")).alias("rank"))
    return d.select(F.col("doc_id").alias("turn_id"), "text"), b


_GROUND = f"""WITH {_FORMS_SQL}, {_WORDS_SQL}, m AS (SELECT doc_id, label, count(*) AS n FROM w JOIN forms USING (form) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rank FROM m),
f AS (SELECT doc_id AS turn_id, label, CASE WHEN rank > 1 THEN 'unearned_mention' END AS kind FROM b)"""


@query(f"{_GROUND} SELECT turn_id, label, kind FROM f WHERE kind = 'unearned_mention'")
def grounding(spark, sf_dir):
    """Labels named beyond the belief's first."""
    turns, beliefs = _word_beliefs(spark, sf_dir)
    return grounding_findings(turns, beliefs, forms(spark), top_n=1).where("kind = 'unearned_mention'")


@query(f"{_GROUND} SELECT d.doc_id AS turn_id, CASE WHEN length(text) < {MIN_CHARS} THEN 'stub_reasoning' ELSE 'unearned_mention' END AS reason FROM documents d WHERE length(text) < {MIN_CHARS} OR doc_id IN (SELECT turn_id FROM f WHERE kind = 'unearned_mention')")
def trace_filter(spark, sf_dir):
    """Rejected traces with a reason: a stub, or an unearned mention."""
    turns, beliefs = _word_beliefs(spark, sf_dir)
    bad = grounding_findings(turns, beliefs, forms(spark), top_n=1).where("kind = 'unearned_mention'").select("turn_id").distinct().withColumn("bad", F.lit(True))
    j = turns.join(bad, "turn_id", "left")
    reason = F.when(F.length("text") < MIN_CHARS, "stub_reasoning").when(F.col("bad"), "unearned_mention")
    return j.select("turn_id", reason.alias("reason")).where("reason IS NOT NULL")


_DRAWN = f"pr AS (SELECT lang AS label, count(*) * 1.0e0 / sum(count(*)) OVER () AS p FROM documents GROUP BY 1), cd AS (SELECT label, sum(p) OVER (ORDER BY label) AS c FROM pr), dl AS (SELECT doc_id, lang, coalesce((SELECT min(label) FROM cd WHERE c >= u), (SELECT max(label) FROM cd)) AS drawn FROM (SELECT doc_id, lang, ('0x' || substr(md5('13:' || doc_id), 1, 13))::BIGINT::DOUBLE / {2.0**52} AS u FROM documents))"


@query(f"{_GROUND}, {_DRAWN} SELECT lang, round(avg(EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id AND label = lang)::INT), 6) AS truth_rate, round(avg(EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id AND label = drawn)::INT), 6) AS null_rate FROM dl d GROUP BY 1")
def deleak_ablation(spark, sf_dir):
    """How often texts name their label, against a label drawn from the prior."""
    from marlstone.operators.splits import drawn

    d = table(spark, sf_dir, "documents")
    prior = d.groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("k")).withColumn("p", F.col("k") / F.sum("k").over(W.partitionBy())).select("label", "p")
    x = drawn(d.select("doc_id", "lang"), prior, 13, "doc_id")
    m = mentions(d, spark).withColumnRenamed("doc_id", "m_id")
    j = x.join(m, F.col("doc_id") == F.col("m_id"), "left").groupBy("doc_id", "lang").agg(F.coalesce(F.bool_or(F.col("label") == F.col("lang")), F.lit(False)).alias("own"), F.coalesce(F.bool_or(F.col("label") == F.col("drawn")), F.lit(False)).alias("other"))
    return j.groupBy("lang").agg(F.round(F.avg(F.col("own").cast("int")), 6).alias("truth_rate"), F.round(F.avg(F.col("other").cast("int")), 6).alias("null_rate"))


@query("WITH a AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, 'stub_reasoning' AS reasons FROM a WHERE turn <> last AND length(text) < 200")
def turn_filter(spark, sf_dir):
    """Assistant turns with too little text; the last of each is exempt."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    last = F.col("turn") == F.max("turn").over(W.partitionBy("conv_id"))
    turns = c.select(F.struct("conv_id", "turn").alias("turn_id"), "text", last.alias("concludes"))
    none = turns.select("turn_id", F.lit("").alias("kind")).where("false")
    return traces_rejected(turns, none, 200).select("turn_id.conv_id", "turn_id.turn", F.array_join("reasons", ",").alias("reasons"))
