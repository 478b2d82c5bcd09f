"""Text functions as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, trimmed."""
    return F.trim(F.coalesce(*[F.when(c == "", None).otherwise(c) for c in columns]))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_text(c: Column, limit: int | None = None) -> Column:
    """Collapsed white space; a longer text is cut at its last space and gets dots. A null is empty."""
    t = collapse(F.coalesce(c, F.lit("")))
    if not limit:
        return t
    cut = F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", "")
    return F.when(F.length(t) > limit, F.concat(cut, F.lit("..."))).otherwise(t)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?][ \t\n\x0B\f\r]+"), lambda s: F.trim(s)), lambda s: s != "")


def unfenced(c: Column) -> Column:
    """A reply without its code fence."""
    return F.trim(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\n?|```$", ""))


def relaxed_json(c: Column) -> Column:
    """JSON without commas before a closing bracket."""
    return F.regexp_replace(unfenced(c), r",(\s*[\]}])", "$1")


def claims_of_reply(reply: Column, transcript: Column, fallback: int = 3) -> Column:
    """Strings of a JSON array; of another reply the first sentences of the transcript."""
    return F.coalesce(F.from_json(relaxed_json(reply), "array<string>"), F.slice(sentences(transcript), 1, fallback))


def fallback_query(c: Column, words: int = 6) -> Column:
    return F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Za-z']+)"))), 1, words), " ")


#: Spellings of the two tags that a query may have.
MESH_TAGS = ("MeSH", "mesh", "MeSH Terms", "MeSH terms", "MH", "mh")
TAGS = ("mh", "tiab")


def clean_query(c: Column) -> Column:
    """A literature query with tags mh and tiab only and as many opening as closing brackets, else null.

    Backticks and quotes go at its ends, quotes around a tagged phrase too; spellings of
    the tag mh are taken as they stand, other spellings make a query invalid.
    """
    q = F.trim(F.btrim(F.trim(c), F.lit("`")))
    q = F.trim(F.btrim(F.btrim(q, F.lit('"')), F.lit("'")))
    q = F.regexp_replace(q, rf"\[(?:{'|'.join(MESH_TAGS)})\]", "[mh]")
    q = collapse(F.regexp_replace(q, r'"([^"]+)"(?=\[(?:mh|tiab)\])', "$1"))
    q = F.regexp_replace(F.regexp_replace(q, r"(?i)\band\b", "AND"), r"(?i)\bor\b", "OR")
    tags = F.regexp_extract_all(q, F.lit(r"\[([^\]]+)\]"))
    bad = F.size(F.array_except(tags, F.array(*map(F.lit, TAGS)))) > 0
    uneven = F.length(F.translate(q, "(", "")) != F.length(F.translate(q, ")", ""))
    return F.when(bad | uneven, None).otherwise(q)


def verdict_of_reply(reply: Column) -> Column:
    """struct(verdict, score) of a reply that states both; else uncertain and 0."""
    v = F.regexp_extract(reply, r"(?i)VERDICT:\s*(true|false|uncertain)", 1)
    s = F.regexp_extract(reply, r"(?i)FINALSCORE:\s*([0-1](?:\.\d+)?)", 1)
    both = (v != "") & (s != "")
    return F.struct(F.when(both, F.lower(v)).otherwise("uncertain").alias("verdict"), F.when(both, F.expr("0D") + F.when(s == "", None).otherwise(s).cast("double")).otherwise(0.0).alias("score"))


def reason_of_reply(reply: Column) -> Column:
    """The reply itself where it states verdict and score, else what is said in its place."""
    ok = reply.rlike(r"(?i)VERDICT:\s*(true|false|uncertain)") & reply.rlike(r"(?i)FINALSCORE:\s*[0-1](?:\.\d+)?")
    return F.when(ok, reply).otherwise(F.concat(F.lit("Unparsable output:\n"), F.coalesce(reply, F.lit(""))))


def normalised_verdict(verdict: Column) -> Column:
    """Lower case without space around it; an empty one is null."""
    return F.when(verdict == "", None).otherwise(F.lower(F.trim(verdict)))


def verdict_label(verdict: Column) -> Column:
    v = F.lower(F.trim(verdict))
    return F.when(v == "true", 0).when(v == "uncertain", 1).when(v == "false", 2)


def stance_label(supports: Column, refutes: Column, threshold: float = 0.0) -> Column:
    return F.when(F.greatest(supports, refutes) < threshold, "Neutral").when(supports >= refutes, "Supports").otherwise("Refutes")


def score_percent(c: Column) -> Column:
    x = c.try_cast("double")
    p = F.when((x >= 0) & (x <= 1), x * 100).when((x > 1) & (x <= 100), x)
    return F.floor(p + 0.5)


def score_band(percent: Column) -> Column:
    return F.when(percent <= 30, "low").when(percent <= 75, "medium").when(percent.isNotNull(), "high")


def sanitized_name(c: Column, default: str = "Unnamed_Pipeline") -> Column:
    """White space to one underscore, then nothing but letters, digits, dot, dash and underscore."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), SPACE, "_"), r"[^A-Za-z0-9._-]+", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def cut_long(c: Column, limit: int = 1000) -> Column:
    """A longer text is cut and says by how many characters."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("... [truncated "), (F.length(c) - limit).cast("string"), F.lit(" chars]"))).otherwise(c)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on")


def two_decimals(c: Column) -> Column:
    """Null for null and for what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNotNull(), F.format_string("%.2f", x))


#: What a line calls its source.
SOURCE_LABELS = {"PubMed": "PMID", "Epistemonikos": "EPIST", "RAG": "RAG"}


def source_line(source: Column, weight: Column, relevance: Column, stance: Column, supports: Column, refutes: Column, neutral: Column, text: Column | None, missing: str | None = "text: [no content]") -> Column:
    """One line of evidence for a prompt: source, weight, relevance, stance with its
    probabilities, text. Parts that are null are left out; text None leaves it out whole."""
    label = F.lit("SOURCE")
    for kind, name in SOURCE_LABELS.items():
        label = F.when(source == kind, name).otherwise(label)
    led = lambda word, c: F.when(two_decimals(c).isNotNull(), F.concat(F.lit(word), two_decimals(c)))
    some = F.coalesce(supports, refutes, neutral).isNotNull()
    shares = F.when(some, F.concat(F.lit(" ("), F.concat_ws(" ", led("S", supports), led("R", refutes), led("N", neutral)), F.lit(")"))).otherwise("")
    stood = F.when((F.coalesce(stance, F.lit("")) != "") | some, F.concat(F.lit("stance abs "), F.coalesce(stance, F.lit("NA")), shares))
    parts = [label, led("w ", weight), led("rel ", relevance), stood]
    if text is not None:
        body = F.nullif(one_line(text), F.lit(""))
        parts.append(F.coalesce(F.concat(F.lit("text: "), body), F.lit(missing).cast("string")))
    return F.concat(F.lit("- "), F.concat_ws(" | ", *parts))


def chunk_line(score: Column, weight: Column, text: Column | None) -> Column:
    """One line of a retrieved passage for a prompt."""
    led = lambda word, c: F.when(two_decimals(c).isNotNull(), F.concat(F.lit(word), two_decimals(c)))
    parts = [F.lit("RAG"), led("score ", score), led("w ", weight)]
    if text is not None:
        parts.append(F.concat(F.lit("abstract: "), F.coalesce(F.nullif(one_line(text), F.lit("")), F.lit("[no abstract]"))))
    return F.concat(F.lit("- "), F.concat_ws(" | ", *parts))


def one_line(c: Column) -> Column:
    """A text without white space around it, each newline a space."""
    return F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}|{SPACE}$", ""), "\n", " ")


def filled(template: str, **values: Column) -> Column:
    """A prompt: the template with {name} replaced by columns; null is empty, {{ and }} are braces.

    Raises on a name without a column.
    """
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def passage(title: Column, body: Column) -> Column:
    """Title, empty line, body. With a title a missing body reads None, as scorers were given it."""
    both = F.concat(F.trim(title), F.lit("\n\n"), F.coalesce(body, F.lit("None")))
    return F.nullif(F.trim(F.when(F.coalesce(title, F.lit("")) != "", both).otherwise(body)), F.lit(""))


def article_url(pubmed_id: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pubmed_id, F.lit("/"))


def article_id(given: Column) -> Column:
    """An id of digits, or that in an article's URL, else null."""
    found = F.regexp_extract(given, r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)/?", 1)
    return F.when(given.rlike(r"^\d+$"), given).when(found != "", found)


def short_code(url: Column, markers: tuple[str, ...] = ("reel", "reels", "p")) -> Column:
    """The part of a URL's path after the first of the markers that has one, else null."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    parts = F.split(path, "/")
    after = [F.when(F.array_position(parts, m) > 0, F.get(parts, F.array_position(parts, m).cast("int"))) for m in markers]
    return F.coalesce(*after)


def statement_of_answer(answer: Column, question: Column) -> Column:
    """A rewritten question: without a leading "A:" or "Answer:" and quotes around it; an
    empty one is the question without its question mark."""
    t = F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"^(?:A|Answer) ?:\s*", "")
    quoted = (t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'"))
    t = F.when(quoted & (F.length(t) > 1), F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.when(t == "", F.trim(F.rtrim(F.trim(question), F.lit("?")))).otherwise(t)


def endpoint(url: Column, path: str = "/api/tags") -> Column:
    """A service's own path in place of a final /v1."""
    return F.concat(F.regexp_replace(F.rtrim(url, F.lit("/")), "/v1$", ""), F.lit(path))


def trimmed_lines(c: Column) -> Column:
    """Each line without space at its end, the whole without space around it."""
    lines = F.transform(F.split(c, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, f"{SPACE}$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), f"^{SPACE}|{SPACE}$", "")


def context_limit(parameters: Column) -> Column:
    return F.regexp_extract(parameters, r"(?:num_ctx|n_ctx|context_length)\s*[:=]?\s*(\d+)", 1).try_cast("int")


def listed(c: Column) -> Column:
    """One text as a list of one; a null is no list."""
    return F.when(c.isNotNull(), F.array(c))


def holds(items: Column, value: Column) -> Column:
    """Whether a list has a value, whatever its case."""
    return F.exists(items, lambda x: F.lower(x) == F.lower(value))


def page_numbers(json: Column) -> Column:
    """A JSON list of integers; anything else is an empty list."""
    return F.coalesce(F.from_json(json, "array<int>"), F.array().cast("array<int>"))


def utc_text(c: Column) -> Column:
    """A timestamp of a UTC session to the second, with Z."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def run_id(name: Column, item: Column, worker: Column, at: Column) -> Column:
    return F.concat_ws("_", sanitized_name(name), item.cast("string"), worker.cast("string"), F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"))


def document_key(path: Column, digest: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit("::"), digest), 256), 1, 32)


def cache_key(tool: Column, params: Column) -> Column:
    """md5 of the tool and its parameters (a map) as JSON with sorted keys."""
    return F.md5(F.concat(tool, F.lit("|"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))))
