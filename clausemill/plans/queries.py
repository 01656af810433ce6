"""One query for each operator, over the test tables; its SQL stands beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import jsonrules as J
from ..functions import patterns as P
from ..functions import text as T
from ..operators import dedup, guard, ingest, metrics, mining, rules
from . import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(text: str, read: Callable[[str], str]) -> str:
    for name in ("orders", "part", "lineitem", "labels"):
        text = text.replace("{" + name + "}", read(name))
    return text


class Tables:
    """The test tables of a folder, and the policy text derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def parts(self) -> DataFrame:
        """`part` dealt over all tasks: its file is one split for want of size, however much is computed from a row."""
        return self["part"].repartition(2 * self.spark.sparkContext.defaultParallelism, "p_partkey")

    def derived(self, sql: str) -> DataFrame:
        used = {n: self.parts() if n == "part" else self[n] for n in ("orders", "part", "lineitem", "labels") if "{" + n + "}" in sql}
        escaped = sql.replace("{", "{{").replace("}", "}}")
        for name in used:
            escaped = escaped.replace("{{" + name + "}}", "{" + name + "}")
        return self.spark.sql(escaped, **used)

    @cached_property
    def clauses(self) -> DataFrame:
        return self.derived(corpus.CLAUSES)

    @cached_property
    def spans(self) -> DataFrame:
        return self.clauses.withColumn("section_path", F.split("section", r"\|")).withColumn("sent_index", F.lit(0))

    @cached_property
    def rules(self) -> DataFrame:
        flat = self.derived(corpus.RULES)

        def listed(c: str) -> Column:
            return F.filter(F.split(c, r"\|"), lambda x: x != "").alias(c)

        return flat.select(
            "seq", "rule_id", F.struct("doc", "citation", "span_id").alias("source"), F.struct(*[listed(c) for c in ("actor", "data_domain", "context")]).alias("scope"), "hazard",
            *[listed(c) for c in ("conditions", "exceptions", "requirements", "evidence")], "severity", "is_testable", F.struct(listed("signals").alias("evidence_signals")).alias("testability"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        return self.derived(corpus.RAW)

    @cached_property
    def blocks(self) -> DataFrame:
        return self.derived(corpus.BLOCKS)

    @cached_property
    def scores(self) -> DataFrame:
        return self.derived(corpus.SCORES)

    @cached_property
    def pairs(self) -> DataFrame:
        return dedup.similar_pairs(self["embeddings"].select("vec_id", "label", "embedding"), 0.25, seq="vec_id", block="label", vector="embedding")


# --- SQL of the derived tables, as common table expressions
_NOW = {n: _sql(getattr(corpus, n), lambda t: t) for n in ("CLAUSES", "RULES", "RAW", "BLOCKS", "SCORES")}
_LISTED = "list_filter(string_split({0}, '|'), lambda x: x <> '')"


def _lists(*columns: str) -> str:
    return ", ".join(f"{_LISTED.format(c)} AS {c}" for c in columns)


_WITH = {
    "clauses": f"clauses AS ({_NOW['CLAUSES']})",
    "rules": f"rules AS (SELECT * REPLACE ({_lists('actor', 'data_domain', 'context', 'conditions', 'exceptions', 'requirements', 'evidence', 'signals')}) FROM ({_NOW['RULES']}))",
    "raw": f"raw AS ({_NOW['RAW']})",
    "blocks": f"blocks AS ({_NOW['BLOCKS']})",
    "scores": f"scores AS ({_NOW['SCORES']})",
    "units": "units AS (SELECT vec_id AS seq, label AS block, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS unit FROM embeddings)",
    "pairs": "pairs AS (SELECT * FROM (SELECT a.seq AS a, b.seq AS b, a.block AS block, list_sum(list_transform(list_zip(a.unit, b.unit), lambda z: z[1] * z[2])) AS sim FROM units a JOIN units b ON a.block = b.block AND a.seq < b.seq) WHERE sim >= 0.25)",
}


def query(*uses: str, sql: str | None = None, recursive: bool = False):
    """Registers a query; `uses` names the derived tables that its SQL begins with."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            parts = [_WITH[u] for u in uses]
            head = ("WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + " ") if parts else ""
            body = sql.strip()
            if head and body.upper().startswith("WITH "):
                body = ", " + body[5:]
            ORACLE_SQL[f.__name__] = head + body
        return f

    return register


def _s(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_s(pattern)})"


def _j(column: Column | str, by: str = "|") -> Column:
    return F.array_join(column, by)


# --- classification of clauses
_TYPE = f"""CASE WHEN {_has('lower(text)', P.EXEMPTION)} THEN 'exemption' WHEN {_has('lower(text)', P.EXCEPTION)} THEN 'exception'
  WHEN {_has('lower(text)', P.PROHIBITED)} THEN 'prohibition' WHEN {_has('lower(text)', P.DEFINITION)} THEN 'definition'
  WHEN {_has('lower(text)', P.DEONTIC)} AND NOT {_has(f"regexp_replace(lower(text), {_s(P.MAY_WITH)}, ' ', 'g')", P.PLAIN_MAY)} THEN 'obligation' ELSE 'other' END"""
_SEVERITY = f"CASE WHEN {_has('text', P.SEVERE_UPPER)} OR {_has('text', P.SEVERE)} THEN 'high' ELSE 'medium' END"
_CUES = {n: f"CASE WHEN {_has('text', p)} THEN {_s(P.CUES[n])} END" for n, p in (("deontic", P.DEONTIC), ("exception", P.EXCEPTION), ("exemption", P.EXEMPTION))}
_CUE_LIST = f"list_filter([{', '.join(_CUES.values())}], lambda x: x IS NOT NULL)"
_NORMATIVE = f"NOT ({_has('path', P.INFORMATIVE)} AND NOT {_has('path', P.NORMATIVE)})"
_LOCAL = f"NOT ({_has('text', P.INFORMATIVE)} AND NOT {_has('text', P.NORMATIVE)})"
_MINABLE = f"text <> '' AND NOT {_has('text', P.ADMINISTRATIVE)} AND NOT {_has('text', P.EPISTEMIC)}"
_CONFIDENCE = """greatest(0.05, least(0.95, round(CASE WHEN {t} IN ('obligation', 'prohibition', 'exception', 'exemption') THEN 0.4 ELSE 0.2 END + least(0.2, 0.05 * {n})
  + CASE WHEN {norm} THEN 0.2 ELSE 0 END - CASE WHEN {t} = 'definition' THEN 0.2 ELSE 0 END
  - CASE WHEN contains(lower(text), 'example:') OR contains(text, '“') OR contains(text, '”') THEN 0.05 ELSE 0 END, 2)))"""


@query("clauses", sql=f"SELECT seq, {_TYPE} AS type FROM clauses")
def clause_type(t: Tables) -> DataFrame:
    return t.clauses.select("seq", C.clause_type(F.col("text")).alias("type"))


@query("clauses", sql=f"SELECT seq, {_SEVERITY} AS severity FROM clauses")
def clause_severity(t: Tables) -> DataFrame:
    return t.clauses.select("seq", C.clause_severity(F.col("text")).alias("severity"))


@query("clauses", sql=f"SELECT * FROM (SELECT seq, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_s(P.CROSS_REFERENCE)}), lambda x: trim(x)))), '|') AS refs FROM clauses) WHERE refs <> ''")
def clause_crossrefs(t: Tables) -> DataFrame:
    return t.clauses.select("seq", _j(C.cross_references(F.col("text"))).alias("refs")).where("refs <> ''")


@query("clauses", sql=f"""SELECT seq, nullif(regexp_extract(text, {_s(P.DEADLINE)}, 1), '') AS cue, TRY_CAST(nullif(regexp_extract(text, {_s(P.DEADLINE)}, 2), '') AS INT) AS value,
  nullif(regexp_extract(text, {_s(P.DEADLINE)}, 3), '') AS unit, nullif(regexp_extract(text, {_s(P.THRESHOLD)}, 1), '') AS cmp, nullif(regexp_extract(text, {_s(P.THRESHOLD)}, 2), '') AS bound,
  {_has('text', P.JURISDICTION)} AS jurisdictional FROM clauses""")
def clause_meta(t: Tables) -> DataFrame:
    d, h = C.deadline(F.col("text")), C.threshold(F.col("text"))
    return t.clauses.select("seq", d["cue"].alias("cue"), d["value"].alias("value"), d["unit"].alias("unit"), h["cmp"].alias("cmp"), h["value"].alias("bound"), C.has(F.col("text"), P.JURISDICTION).alias("jurisdictional"))


@query("clauses", sql=f"SELECT seq, {_CONFIDENCE.format(t='type', n='n', norm='norm')} AS confidence FROM (SELECT seq, text, {_TYPE} AS type, len({_CUE_LIST}) AS n, {_NORMATIVE} AS norm FROM (SELECT *, replace(section, '|', ' / ') AS path FROM clauses))")
def clause_confidence(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.spans.select("seq", C.confidence(text, C.clause_type(text), F.size(C.cues(text)), C.normative_section(F.col("section_path"))).alias("confidence"))


@query("clauses", sql=f"SELECT seq, array_to_string({_CUE_LIST}, '~') AS cues FROM clauses")
def clause_cues(t: Tables) -> DataFrame:
    return t.clauses.select("seq", _j(C.cues(F.col("text")), "~").alias("cues"))


@query("clauses", sql=f"SELECT seq, type FROM (SELECT seq, text, {_TYPE} AS type FROM clauses WHERE {_MINABLE}) WHERE type IN ('obligation', 'prohibition', 'exception', 'exemption') AND NOT (type = 'prohibition' AND NOT {_has('text', P.ACTOR)})")
def clause_filter(t: Tables) -> DataFrame:
    rows = t.clauses.where(C.minable(F.col("text"))).withColumn("type", C.clause_type(F.col("text"))).where(F.col("type").isin(*C.CORE_TYPES))
    return rows.where(~((F.col("type") == "prohibition") & ~C.has(F.col("text"), P.ACTOR))).select("seq", "type")


@query("clauses", sql=f"SELECT seq, {_NORMATIVE} AS normative FROM (SELECT *, replace(section, '|', ' / ') AS path FROM clauses)")
def section_normative(t: Tables) -> DataFrame:
    return t.spans.select("seq", C.normative_section(F.col("section_path")).alias("normative"))


def _said(words, *where: str) -> str:
    return "(" + " OR ".join(f"contains({w}, {_s(x)})" for x in words for w in where) + ")"


_CONTEXT_SEVERITY = f"""CASE WHEN {_said(P.HINTS['critical'], 'd', 'c', 't')} THEN 'critical' WHEN {_said(P.HINTS['regulation'], 'd', 'c')} THEN 'high'
  WHEN {_said(P.HINTS['guidance'], 'd', 'c')} THEN 'medium' WHEN {_said(P.HINTS['escalation'], 't')} THEN 'high' ELSE 'medium' END"""


@query("rules", sql=f"SELECT seq, {_CONTEXT_SEVERITY} AS severity FROM (SELECT seq, lower(doc) AS d, lower(citation) AS c, lower(hazard) AS t FROM rules)")
def doc_severity(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.context_severity(F.col("source.doc"), F.col("source.citation"), F.col("hazard")).alias("severity"))


_NEGATIVE = _said(P.NEGATIVE, "lower(array_to_string(requirements, ' '))")


@query("rules", sql=f"SELECT doc, bool_or({_NEGATIVE}) AS negative, count(*) FILTER (WHERE {_NEGATIVE}) AS n FROM rules GROUP BY doc")
def polarity(t: Tables) -> DataFrame:
    neg = C.is_negative(F.col("requirements"))
    return t.rules.groupBy(F.col("source.doc").alias("doc")).agg(F.bool_or(neg).alias("negative"), F.count_if(neg).alias("n"))


@query("clauses", sql=f"SELECT seq, array_to_string(regexp_extract_all(text, {_s(P.DEONTIC)}), '|') AS deontic, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_s(P.ACTOR)}))), '|') AS actors FROM clauses")
def mining_tools(t: Tables) -> DataFrame:
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (P.DEONTIC, P.ACTOR)]
    return t.clauses.select("seq", _j(found[0]).alias("deontic"), _j(F.array_sort(F.array_distinct(found[1]))).alias("actors"))


# --- testability
_REQ = "array_to_string(requirements, ' ')"
_SIGNAL_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_has(f'lower({_REQ})', p)} THEN '{n}' END" for n, p in P.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"


def _req() -> Column:
    return F.array_join("requirements", " ")


@query("rules", sql=f"SELECT seq, {_has(_REQ, P.ACTIONABLE)} AS actionable, array_to_string(regexp_extract_all({_REQ}, {_s(P.ACTIONABLE)}), '|') AS tokens FROM rules")
def actionable(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.has(_req(), P.ACTIONABLE).alias("actionable"), _j(C.actionable_tokens(_req())).alias("tokens"))


@query("rules", sql="SELECT seq, " + ", ".join(f"nullif(regexp_extract({_REQ}, {_s(p)}, 1), '') AS {n}" for n, p in (("actor", P.BOUND_ACTOR), ("data", P.BOUND_DATA), ("condition", P.BOUND_CONDITION))) + " FROM rules")
def bounded(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.bounds(_req()).alias("b")).select("seq", "b.*")


@query("rules", sql=f"SELECT seq, array_to_string({_SIGNAL_LIST}, '|') AS signals FROM rules")
def evidence_signals(t: Tables) -> DataFrame:
    return t.rules.select("seq", _j(C.evidence_signals(_req())).alias("signals"))


@query("rules", sql=f"SELECT seq, len({_SIGNAL_LIST}) > 0 AS observable FROM rules")
def observable(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.observable(C.evidence_signals(_req())).alias("observable"))


@query("rules", sql=f"SELECT seq, {_has(_REQ, P.ACTIONABLE)} AND ({_has(_REQ, P.BOUND_ACTOR)} OR {_has(_REQ, P.BOUND_DATA)} OR {_has(_REQ, P.BOUND_CONDITION)}) AND len({_SIGNAL_LIST}) > 0 AS testable FROM rules")
def testable(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.testable(_req()).alias("testable"))


@query("rules", sql=f"SELECT seq, CASE WHEN {_has('b', P.REPAIR_CRITICAL)} THEN 'critical' WHEN {_has('r', P.SEVERE_UPPER)} OR {_has('b', P.REPAIR_HIGH)} THEN 'high' WHEN {_has('b', P.REPAIR_MEDIUM)} THEN 'medium' ELSE 'low' END AS severity FROM (SELECT seq, {_REQ} AS r, lower({_REQ} || ' ' || hazard) AS b FROM rules)")
def severity_repair(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.repaired_severity(_req(), F.col("hazard")).alias("severity"))


_NAMES = "list_transform(signals, lambda s: lower(trim(s)))"


@query("rules", sql=f"SELECT seq, is_testable AND list_contains({_NAMES}, 'io_check') AS io_any FROM rules")
def io_any(t: Tables) -> DataFrame:
    return t.rules.select("seq", C.checks_io(F.col("is_testable"), F.col("testability.evidence_signals")).alias("io_any"))


@query("rules", sql=f"SELECT seq, len(signals) = 1 AND coalesce(({_NAMES})[1] = 'io_check', false) AS io_only FROM rules")
def io_only(t: Tables) -> DataFrame:
    return t.rules.select("seq", (F.coalesce(C.checks_io_only(F.col("testability.evidence_signals")), F.lit(False))).alias("io_only"))


# --- text
_WS = r"[ \t\n\x0B\f\r]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(sql=f"SELECT doc_id, CAST(len(s) AS INT) AS n, sha1(array_to_string(s, chr(30))) AS h FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_strip_sql('text')}, '([.!?]){_WS}+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS s FROM documents)")
def sent_split(t: Tables) -> DataFrame:
    s = T.sentences(F.col("text"))
    return t["documents"].select("doc_id", F.size(s).alias("n"), F.sha1(F.array_join(s, "\x1e").cast("binary")).alias("h"))


@query(sql="SELECT doc_id, i AS n, array_to_string(w[(i - 1) * 4 + 1:i * 4], '|') AS chunk FROM (SELECT doc_id, w, unnest(range(1, CAST(ceil(len(w) / 4.0) AS BIGINT) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def chunked(t: Tables) -> DataFrame:
    rows = t["documents"].select("doc_id", F.posexplode(T.chunked(F.split("text", " "), 4)).alias("n", "chunk"))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), _j("chunk").alias("chunk"))


@query(sql="SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 8) AS h FROM documents")
def sha8(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.sha8(F.col("text")).alias("h"))


@query(sql=f"SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower({_strip_sql('text')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'section') AS slug FROM documents")
def slug(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(sql=r"SELECT conv_id, turn, sha1(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{2,}', chr(10), 'g')) AS h FROM (SELECT conv_id, turn, replace(text, '. ', '-' || chr(10)) AS text FROM conversations)")
def dehyphen(t: Tables) -> DataFrame:
    rows = t["conversations"].select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit("-\n")).alias("text"))
    return rows.select("conv_id", "turn", F.sha1(T.join_hyphens(F.col("text")).cast("binary")).alias("h"))


@query(sql=r"SELECT doc_id, sha1(regexp_replace(text, '[ \t]+', ' ', 'g')) AS h FROM documents")
def normalize_spaces(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.sha1(T.single_blanks(F.col("text")).cast("binary")).alias("h"))


def _norm_sql(x: str) -> str:
    return f"regexp_replace(translate({_strip_sql(f'lower({x})')}, {_s(T.PUNCTUATION)}, ''), '{_WS}+', ' ', 'g')"


def _phrase_sql(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g')"
    return _strip_sql(f"regexp_replace({plain}, '{_WS}+', ' ', 'g')")


@query(sql=f"SELECT doc_id, sha1({_norm_sql('text')}) AS h FROM documents")
def norm_txt(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.sha1(T.norm_text(F.col("text")).cast("binary")).alias("h"))


@query(sql=f"SELECT doc_id, sha1({_phrase_sql('text')}) AS h FROM documents")
def norm_phrase(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.sha1(T.norm_phrase(F.col("text")).cast("binary")).alias("h"))


def _token_sql(x: str) -> str:
    plain = f"lower(translate({x}, '{T.ACCENTED}', '{T.PLAIN}'))"
    return f"regexp_replace(translate({_strip_sql(plain)}, '_-', '  '), '{_WS}+', ' ', 'g')"


@query(sql=f"SELECT doc_id, {_token_sql('text')} AS token FROM documents")
def tok_norm(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.norm_token(F.col("text")).alias("token"))


_SINGULAR = "CASE WHEN {0} LIKE '%ies' THEN left({0}, len({0}) - 3) || 'y' WHEN {0} LIKE '%sses' THEN left({0}, len({0}) - 2) WHEN {0} LIKE '%ses' THEN left({0}, len({0}) - 2) WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, len({0}) - 1) ELSE {0} END"


@query(sql=f"SELECT w, {_SINGULAR.format('w')} AS singular FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> ''")
def singularize(t: Tables) -> DataFrame:
    words = t["documents"].select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().where("w <> ''")
    return words.select("w", T.singular(F.col("w")).alias("singular"))


def _canonical_sql(x: str, slot: str) -> str:
    from ..schema import ENUMS, KEYWORDS, SYNONYMS

    n, one = _token_sql(x), _SINGULAR.format(f"({_token_sql(x)})")
    synonyms = "CASE {0} " + " ".join(f"WHEN {_s(w)} THEN {_s(k)}" for k, ws in SYNONYMS[slot].items() for w in ws) + " END"
    tokens = "CASE " + " ".join(f"WHEN {{0}} = {_s(k)} THEN {_s(k)}" for k in ENUMS[slot]) + " END"
    words = "CASE " + " ".join(f"WHEN contains({n}, {_s(k)}) THEN {_s(v)}" for k, v in KEYWORDS[slot]) + " END"
    return f"coalesce({synonyms.format(n)}, {tokens.format(n)}, {synonyms.format(one)}, {tokens.format(one)}, {words})"


def _ordered_sql(column: str) -> str:
    """A list without later repeats and nulls, as text."""
    return f"array_to_string(list_filter({column}, lambda v, i: v IS NOT NULL AND list_position({column}, v) = i), '|')"


_CANON = "SELECT * REPLACE (" + ", ".join(f"list_transform({c}, lambda v: {_canonical_sql('v', c)}) AS {c}" for c in ("actor", "data_domain", "context")) + ") FROM rules"


@query("rules", sql="SELECT seq, " + ", ".join(f"{_ordered_sql(c)} AS {c}" for c in ("actor", "data_domain", "context")) + f" FROM ({_CANON})")
def canonicalize(t: Tables) -> DataFrame:
    return t.rules.select("seq", *[_j(T.canonical_list(F.col("scope")[c], c)).alias(c) for c in ("actor", "data_domain", "context")])


_LOOSE = "'high risk','highrisk','HIGH-RISK','onprem','on prem','ci','C I','nothing',''"


@query(sql=f"SELECT o_orderkey, CASE translate(lower(trim(w)), ' -', '') WHEN 'highrisk' THEN 'high-risk' WHEN 'onprem' THEN 'onprem' WHEN 'ci' THEN 'ci' END AS token FROM (SELECT o_orderkey, ([{_LOOSE}])[o_orderkey % 9 + 1] AS w FROM orders)")
def canon_token(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(x.strip("'")) for x in _LOOSE.split(",")]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return t["orders"].select("o_orderkey", T.repaired_token(word, "context").alias("token"))


@query("rules", sql="SELECT seq, regexp_replace(lower(rule_id || ' ' || doc), '[^a-z0-9_]+', '_', 'g') AS name FROM rules")
def file_slug(t: Tables) -> DataFrame:
    return t.rules.select("seq", T.file_slug(F.concat_ws(" ", "rule_id", "source.doc")).alias("name"))


@query("rules", sql="SELECT seq, CASE WHEN contains(lower(doc), 'hipaa') THEN 'hipaa' WHEN contains(lower(doc), 'who') AND contains(lower(doc), 'health') THEN 'who' WHEN contains(lower(doc), 'eu ai act') OR (contains(lower(doc), 'art.') AND contains(lower(doc), 'eu')) THEN 'euai' WHEN contains(lower(doc), 'cc by') OR contains(lower(doc), 'creative commons') THEN 'ccby' ELSE 'generic' END AS corpus FROM rules")
def corpus_name(t: Tables) -> DataFrame:
    return t.rules.select("seq", T.corpus_name(F.col("source.doc")).alias("corpus"))


@query("rules", sql="SELECT seq, coalesce(nullif(trim(citation), ''), CASE WHEN len(string_split(span_id, '/')) >= 2 THEN array_to_string(string_split(span_id, '/')[2:3], '/') ELSE '' END) AS citation, CASE WHEN seq % 2 = 0 THEN 'deep' ELSE 'x' END AS doc FROM rules")
def doc_citation(t: Tables) -> DataFrame:
    path = F.when(F.col("seq") % 2 == 0, "/data/deep/out/x.jsonl").otherwise("/data/out/run/x.candidates.jsonl")
    return t.rules.select("seq", T.fallback_citation(F.col("source.span_id"), F.col("source.citation")).alias("citation"), T.fallback_doc(F.lit(""), path, F.col("source.span_id")).alias("doc"))


@query("rules", sql="SELECT seq, left(regexp_replace(regexp_replace(lower(doc), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) || '/' || string_split(span_id, '/')[-1] AS prefix FROM rules")
def stable_id(t: Tables) -> DataFrame:
    return t.rules.select("seq", T.stable_id(F.col("source.doc"), F.col("source.span_id")).alias("prefix"))


_HASH_PARTS = [f"array_to_string({c}, chr(30))" for c in ("requirements", "actor", "data_domain", "context", "exceptions", "conditions")] + ["hazard", "doc", "citation", "span_id", "severity"]
_HASH = f"substr(sha1({' || chr(31) || '.join(_HASH_PARTS)}), 1, 8)"


@query("rules", sql=f"SELECT seq, {_HASH} AS h FROM rules")
def rule_hash(t: Tables) -> DataFrame:
    return t.rules.select("seq", T.rule_hash(rules.fields()).alias("h"))


_HOST = r"nullif(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^\.+|\.+$', '', 'g'), '')"


@query(sql=f"SELECT page_id, {_HOST.format('url')} AS host FROM pages")
def url_host(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", T.url_host(F.col("url")).alias("host"))


@query("rules", sql=f"SELECT seq, array_to_string(list_filter(list_transform(evidence, lambda x: trim(x)), lambda x: x <> '' AND ((NOT contains(x, '://') AND NOT starts_with(lower(x), 'www.')) OR coalesce(ends_with({_HOST.format('x')}, 'nih.gov'), false))), '~') AS evidence FROM rules")
def evidence_allow(t: Tables) -> DataFrame:
    return t.rules.select("seq", _j(T.allowed_evidence(F.col("evidence"), ["nih.gov"]), "~").alias("evidence"))


_SCOPE3 = [f"array_to_string({c}, ',')" for c in ("actor", "data_domain", "context")]
_CLAUSE_TEXT = f"""coalesce(nullif(concat_ws(' | ', CASE WHEN len(requirements) > 0 THEN 'Requirement(s): ' || array_to_string(requirements, ' | ') END,
  CASE WHEN len(exceptions) > 0 THEN 'Exception(s): ' || array_to_string(exceptions, ' | ') END, CASE WHEN hazard <> '' THEN 'Hazard: ' || hazard END,
  CASE WHEN {_SCOPE3[0]} || {_SCOPE3[1]} || {_SCOPE3[2]} <> '' THEN 'Scope: actor[' || {_SCOPE3[0]} || '] data[' || {_SCOPE3[1]} || '] context[' || {_SCOPE3[2]} || ']' END), ''), '(no clause text available)')"""


@query("rules", sql=f"SELECT seq, CASE WHEN seq % 9 = 0 THEN 'given ' || rule_id ELSE {_CLAUSE_TEXT} END AS clause FROM rules")
def clause_text(t: Tables) -> DataFrame:
    given = F.when(F.col("seq") % 9 == 0, F.concat(F.lit(" given "), "rule_id"))
    return t.rules.select("seq", T.clause_text(rules.fields(), [F.lit(" "), given]).alias("clause"))


@query("rules", sql=f"SELECT seq, 'REQ:' || array_to_string(requirements, ' | ') || ' HAZ:' || hazard || ' COND:' || array_to_string(conditions, ' | ') || ' EXC:' || array_to_string(exceptions, ' | ') || ' SEV:' || severity || ' ACT:' || {_SCOPE3[0]} || ';DOM:' || {_SCOPE3[1]} || ';CTX:' || {_SCOPE3[2]} AS text FROM rules")
def semantic_string(t: Tables) -> DataFrame:
    return t.rules.select("seq", T.semantic_string(rules.fields()).alias("text"))


_REQUIREMENT = f"coalesce(nullif(concat_ws(' ', CASE WHEN hazard <> '' THEN 'Hazard: ' || hazard || '.' END, CASE WHEN len(requirements) > 0 THEN 'Requirement: ' || array_to_string(requirements, ' ') END, CASE WHEN len(exceptions) > 0 THEN 'Exceptions: ' || array_to_string(exceptions, '; ') END), ''), {_s(T.DEFAULT_REQUIREMENT)})"


@query("rules", sql=f"SELECT seq, {_REQUIREMENT} AS requirement FROM rules")
def requirement_text(t: Tables) -> DataFrame:
    return t.rules.select("seq", T.requirement_text(rules.fields()).alias("requirement"))


@query(sql="SELECT doc_id, CASE WHEN len(text) > 160 THEN left(text, 160) || '…' ELSE text END AS text FROM documents")
def shorten(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.shorten(F.col("text")).alias("text"))
