"""What a reader is shown, as columns: titles, links, scores, stances, page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import first_text


def _some(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def title(given: Column, pubmed_id: Column, epistemonikos_id: Column, chunk_id: Column) -> Column:
    """A title, else the kind of source with its id."""
    named = [F.concat(F.lit(f"{kind} "), _some(c)) for kind, c in (("PubMed", pubmed_id), ("Epistemonikos", epistemonikos_id), ("RAG", chunk_id))]
    return F.coalesce(_some(given), *named, F.lit("Untitled source"))


def link(url: Column, pubmed_id: Column, epistemonikos_id: Column) -> Column:
    return F.coalesce(
        _some(url), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), _some(pubmed_id), F.lit("/")),
        F.concat(F.lit("https://www.epistemonikos.org/en/documents/"), _some(epistemonikos_id)),
    )


def score_text(c: Column) -> Column:
    """Two decimals; N/A for null or empty, other texts as they are."""
    x = c.cast("string").try_cast("double")
    return F.when(_some(c).isNull(), "N/A").when(x.isNotNull() & ~F.isnan(x), F.format_string("%.2f", x)).otherwise(c.cast("string"))


def kinds_text(kinds: Column) -> Column:
    """Publication types without blanks, comma-separated, or Unknown."""
    kept = F.filter(F.transform(kinds, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit("Unknown"))


def stance_text(label: Column, supports: Column, refutes: Column, neutral: Column) -> Column:
    """The label, else the kind with the highest probability (the first of equal ones), else Unknown."""
    named = ((supports, "Supports", 3), (refutes, "Refutes", 2), (neutral, "Neutral", 1))
    best = F.array_max(F.filter(F.array(*[F.when(p.isNotNull(), F.struct(p.cast("double").alias("p"), F.lit(n).alias("n"), F.lit(k).alias("k"))) for p, k, n in named]), lambda x: x.isNotNull()))
    return F.coalesce(_some(label), best["k"], F.lit("Unknown"))


def stance_class(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.startswith("support"), "stance-supports").when(low.startswith("refute"), "stance-refutes").when(low.startswith("neutral"), "stance-neutral").otherwise("stance-unknown")


def needle(score: Column) -> Column:
    """Degrees of a dial from -90 (0) to 90 (100)."""
    return score * 1.8 - 90


def pair_key(statement: Column, evidence: Column) -> Column:
    """Both places with a colon between; s and e stand in where one is missing or, as zero would, reads false."""
    both = statement.isNotNull() & evidence.isNotNull()
    one = lambda c, name: F.coalesce(F.when(c == 0, None).otherwise(c).cast("string"), F.lit(name))
    return F.when(both, F.concat_ws(":", statement.cast("string"), evidence.cast("string"))).otherwise(F.concat_ws(":", one(statement, "s"), one(evidence, "e")))


def by_relevance(rows: DataFrame, *group: str, rescale: bool = True) -> DataFrame:
    """rows with place: the most relevant of each group first, what is no number last, ties
    in order of ord. A null counts as 0. rescale takes 0 to 1 as shares of 100."""
    raw = F.col("relevance").cast("string")
    x = F.when(raw.isNull() | (F.trim(raw) == ""), 0.0).otherwise(F.trim(raw).try_cast("double"))
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    x = F.when((x >= 0) & (x <= 1), x * 100).otherwise(x) if rescale else x
    w = Window.partitionBy(*group).orderBy(x.desc_nulls_last(), "ord")
    return rows.withColumn("place", F.row_number().over(w))


def visible_area(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Of a rectangle, what lies in a window of this width and height."""
    side = lambda a, b, most: F.greatest(F.lit(0.0), F.least(b, most) - F.greatest(a, F.lit(0.0)))
    return side(left, right, width) * side(top, bottom, height)


def meta_content(html: Column, key: str) -> Column:
    """The content of a page's meta tag with this property, else with this name; empty if neither has any."""
    found = [
        _some(F.regexp_extract(html, rf'(?is)<meta\b(?=[^>]*\b{kind}\s*=\s*["\']{key}["\'])[^>]*\bcontent\s*=\s*["\']([^"\'>]*)["\']', 1)) for kind in ("property", "name")
    ]
    return F.coalesce(*found, F.lit(""))


def page_text(html: Column, limit: int = 2000) -> Column:
    """Title and description of a page's meta tags and its own title, at most `limit` characters."""
    describes = F.coalesce(_some(meta_content(html, "og:description")), _some(meta_content(html, "description")))
    own = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))
    text = F.concat_ws(" ", _some(meta_content(html, "og:title")), describes, _some(own))
    return F.when(F.length(text) > limit, F.substring(text, 1, limit)).otherwise(F.trim(text))


def is_reel(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return path.contains("/reels/") | path.contains("/reel/")


def may_analyse(has_audio: Column) -> Column:
    """Only a page that is known to have no sound is skipped."""
    return F.coalesce(has_audio, F.lit(True))


def log_row(step: Column, indent: Column, is_module: Column, tokens: Column, duration: Column) -> tuple[Column, Column, Column]:
    """(name, duration, tokens) of a run log's entry as a report shows them."""
    pad = F.repeat(F.lit("   "), F.coalesce(indent, F.lit(0)))
    name = F.coalesce(step, F.lit("Unknown"))
    shown = F.when(is_module, F.concat(pad, F.lit(">> "), F.upper(name))).otherwise(F.concat(pad, name))
    count = F.when(is_module, "").when(tokens > 0, tokens.cast("string")).otherwise("-")
    return shown, F.format_string("%.4fs", F.coalesce(duration.cast("double"), F.lit(0.0))), count


def abstract_text(abstract: Column, text: Column, summary: Column, snippet: Column) -> Column:
    return F.coalesce(first_text(abstract, text, summary, snippet), F.lit(""))
