"""String functions: splitting, normalising, canonical tokens, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENUMS, KEYWORDS, REPAIR_UNKNOWN, SYNONYMS

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters that lose an accent; what full decomposition would give for them.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
_SPACE = r"[ \t\n\x0B\f\r]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once; by itself Spark computes an expression at each place that names it, in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_SPACE}+", " ")


def non_blank(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def sentences(text: Column) -> Column:
    """Cut behind . ! ? before a capital or an opening parenthesis."""
    return non_blank(F.transform(F.split(strip(text), rf"(?<=[.!?]){_SPACE}+(?=[A-Z(])"), strip))


def chunked(values: Column, n: int) -> Column:
    """Runs of n elements; the last may be shorter."""

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(n))
        return F.when(F.size(v) > 0, F.transform(starts, lambda i: F.slice(v, i, n))).otherwise(F.array())

    return once(values, cut)


def sha8(text: Column) -> Column:
    return F.substring(F.sha1(or_empty(text).cast("binary")), 1, 8)


def slug(text: Column, most: int = 60) -> Column:
    plain = F.regexp_replace(F.lower(strip(squeeze(or_empty(text)))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(plain, "^-+|-+$", ""), F.lit(most)), F.lit("")), F.lit("section"))


def join_hyphens(text: Column) -> Column:
    """Words broken by a hyphen at a line's end joined; blanks at line ends and empty lines gone."""
    text = F.regexp_replace(text, rf"([\p{{L}}\p{{N}}_])-{_SPACE}*\n{_SPACE}*([\p{{L}}\p{{N}}_])", "$1$2")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{2,}", "\n")


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def norm_text(text: Column) -> Column:
    """For comparing rules: lower case, no ASCII punctuation, single spaces."""
    return squeeze(F.translate(strip(F.lower(or_empty(text))), PUNCTUATION, ""))


def norm_phrase(text: Column) -> Column:
    return strip(squeeze(F.regexp_replace(F.lower(or_empty(text)), "[^a-z0-9 ]+", " ")))


def norm_token(text: Column) -> Column:
    plain = F.lower(F.translate(or_empty(text), ACCENTED, PLAIN))
    return squeeze(F.translate(strip(plain), "_-", "  "))


def singular(word: Column) -> Column:
    def cut(n: int) -> Column:
        return F.left(word, F.length(word) - n)

    return (
        F.when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("sses"), cut(2))
        .when(word.endswith("ses"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def canonical(value: Column, slot: str, vocabulary: dict | None = None) -> Column:
    """The token of a scope slot that a phrase stands for, or null."""
    synonyms = {s: token for token, words in (vocabulary or SYNONYMS)[slot].items() for s in words}
    tokens = {t: t for t in ENUMS[slot]}

    def token(known: Column) -> Column:
        upper = F.when(F.upper(known).isin(*[t for t in tokens if t in ("PHI", "PII")] or [""]), F.upper(known))
        keyword = F.coalesce(*[F.when(known.contains(k), F.lit(t)) for k, t in KEYWORDS[slot]])
        by_word = once(singular(known), lambda word: F.coalesce(_lookup(synonyms, word), _lookup(tokens, word)))
        # an enum hit only where no synonym is known, as synonyms may lead elsewhere
        return F.coalesce(_lookup(synonyms, known), upper, _lookup(tokens, known), by_word, keyword)

    return once(strip(or_empty(value)), lambda v: F.when(v != "", once(norm_token(v), token)))


def canonical_list(values: Column, slot: str) -> Column:
    """Canonical tokens in order of first use; unknown phrases are dropped."""
    found = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: canonical(v, slot))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def repaired_token(value: Column, slot: str) -> Column:
    """A token of the repair step, whatever its case, spaces and hyphens; or null."""
    space = [t for t in ENUMS[slot] if t not in REPAIR_UNKNOWN]
    loose = {t.lower().replace(" ", "").replace("-", ""): t for t in space}
    token = strip(or_empty(value))
    return F.coalesce(F.when(token.isin(*space), token), _lookup(loose, F.translate(F.lower(token), " -", "")))


def file_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_")


def corpus_name(doc: Column) -> Column:
    d = F.lower(or_empty(doc))
    return (
        F.when(d.contains("hipaa"), "hipaa")
        .when(d.contains("who") & d.contains("health"), "who")
        .when(d.contains("eu ai act") | (d.contains("art.") & d.contains("eu")), "euai")
        .when(d.contains("cc by") | d.contains("creative commons"), "ccby")
        .otherwise("generic")
    )


def fallback_citation(span_id: Column, citation: Column) -> Column:
    """A citation, else the second and third part of the span id."""
    parts = F.split(strip(or_empty(span_id)), "/")
    return F.coalesce(F.nullif(strip(or_empty(citation)), F.lit("")), F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 2, 2), "/")), F.lit(""))


def fallback_doc(doc: Column, path: Column, span_id: Column) -> Column:
    """A title, else the folder above the file's folder (but for scratch names), else the file's stem, else the span's head."""
    parts = F.split(or_empty(path), "/")
    above = F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit(""))
    stem = F.replace(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), F.lit(".candidates"), F.lit(""))
    from_path = F.when((above == "") | F.lower(above).isin("out", "tmp", "artifacts"), stem).otherwise(above)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (strip(or_empty(doc)), from_path, F.element_at(F.split(or_empty(span_id), "/"), 1))], F.lit(""))


def stable_id(doc: Column, span_id: Column) -> Column:
    name = F.coalesce(F.nullif(doc, F.lit("")), F.lit("doc"))
    head = F.left(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(40))
    return F.concat(head, F.lit("/"), F.coalesce(F.nullif(F.element_at(F.split(or_empty(span_id), "/"), -1), F.lit("")), F.lit("span")))


def rule_hash(rule: dict[str, Column]) -> Column:
    """First 8 hex digits over a rule's meaning and source, in a fixed order of fields."""
    lists = [F.array_join(rule[c], "\x1e") for c in ("requirements", "actor", "data_domain", "context", "exceptions", "conditions")]
    plain = [or_empty(rule[c]) for c in ("hazard", "doc", "citation", "span_id", "severity")]
    return sha8(F.concat_ws("\x1f", *[F.coalesce(x, F.lit("")) for x in lists + plain]))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(or_empty(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), F.lit(""))


def allowed_evidence(evidence: Column, domains: list[str]) -> Column:
    """Without web addresses whose host ends in none of the domains; other entries stay."""

    def keep(x: Column) -> Column:
        web = x.contains("://") | F.lower(x).startswith("www.")
        host = F.coalesce(url_host(x), F.lit(""))
        good = F.lit(False)
        for d in domains:
            good = good | host.endswith(d.lower())
        return (x != "") & (~web | good)

    return F.filter(F.transform(evidence, strip), keep)


def _joined(values: Column, by: str) -> Column:
    return or_empty(F.array_join(values, by))


def clause_text(rule: dict[str, Column], given: list[Column]) -> Column:
    """The first given text that is not blank, else one composed of the rule's fields."""
    scope = [_joined(rule[c], ",") for c in ("actor", "data_domain", "context")]
    parts = [F.when(_joined(rule["requirements"], " | ") != "", F.concat(F.lit("Requirement(s): "), _joined(rule["requirements"], " | ")))]
    parts.append(F.when(_joined(rule["exceptions"], " | ") != "", F.concat(F.lit("Exception(s): "), _joined(rule["exceptions"], " | "))))
    parts.append(F.when(or_empty(rule["hazard"]) != "", F.concat(F.lit("Hazard: "), rule["hazard"])))
    parts.append(F.when(F.concat(*scope) != "", F.concat(F.lit("Scope: actor["), scope[0], F.lit("] data["), scope[1], F.lit("] context["), scope[2], F.lit("]"))))
    made = F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("(no clause text available)"))
    return F.coalesce(*[F.nullif(strip(x), F.lit("")) for x in given], made)


def semantic_string(rule: dict[str, Column]) -> Column:
    """Text that stands for a rule when it is embedded."""
    scope = [_joined(rule[c], ",") for c in ("actor", "data_domain", "context")]
    return F.concat(
        F.lit("REQ:"), _joined(rule["requirements"], " | "), F.lit(" HAZ:"), or_empty(rule["hazard"]), F.lit(" COND:"), _joined(rule["conditions"], " | "),
        F.lit(" EXC:"), _joined(rule["exceptions"], " | "), F.lit(" SEV:"), or_empty(rule["severity"]), F.lit(" ACT:"), scope[0], F.lit(";DOM:"), scope[1], F.lit(";CTX:"), scope[2],
    )


DEFAULT_REQUIREMENT = "The system must refuse OR show uncertainty OR sanitize unsafe content; benign inputs should be helpful."


def requirement_text(rule: dict[str, Column]) -> Column:
    """What the run-time guard enforces."""
    parts = [
        F.when(or_empty(rule["hazard"]) != "", F.concat(F.lit("Hazard: "), rule["hazard"], F.lit("."))),
        F.when(F.size(rule["requirements"]) > 0, F.concat(F.lit("Requirement: "), _joined(rule["requirements"], " "))),
        F.when(F.size(rule["exceptions"]) > 0, F.concat(F.lit("Exceptions: "), _joined(rule["exceptions"], "; "))),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit(DEFAULT_REQUIREMENT))


def shorten(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)
