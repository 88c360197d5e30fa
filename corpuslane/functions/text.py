"""Text functions over columns. All are built from Spark functions, so they stay inside generated code.

Nulls give null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, a common published list.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some "
    "such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()
)
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Cues of sentence roles.
ROLE_CUES = {
    "method": ("we propose", "we present", "our method", "we introduce", "we develop", "our approach", "this paper presents", "we describe", "in this paper, we", "we design", "our model", "we formulate"),
    "results": ("we show", "outperforms", "achieves", "improves", "our experiments", "results show", "we demonstrate", "state-of-the-art", "our model achieves", "we report", "we obtain", "significantly better", "competitive with", "we evaluate"),
    "background": ("recent work", "has been widely", "existing methods", "previous work", "traditionally", "it is well known", "in recent years", "have shown", "is an important", "remains challenging", "despite", "however,", "current approaches"),
}


def clean_text(c: Column) -> Column:
    """Null gives the empty string; runs of blanks become one space; outer blanks go."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def truncate(c: Column, n: int) -> Column:
    """Blanks collapsed; over ``n`` characters the first n - 3 without trailing blanks, and three dots."""
    t = clean_text(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("..."))).otherwise(t)


def snippet(c: Column, n: int) -> Column:
    """The first ``n`` characters without trailing blanks, with three dots if the text is longer."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def tokens(c: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def content_tokens(c: Column) -> Column:
    """Tokens without English stop words, repeats kept."""
    # Looked up in a hash set; an array would be searched from its start for every token.
    return F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS))


def bigrams(words: Column, glue: str = " ") -> Column:
    """Neighbouring pairs of an array of words."""
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit(glue), b))).otherwise(F.array().cast("array<string>"))


def analyze(c: Column) -> Column:
    """Single words and pairs after stop words are gone."""
    words = content_tokens(c)
    return F.concat(words, bigrams(words))


def split_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != "")


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1)


def word_count(c: Column) -> Column:
    """Runs without blanks; null counts 0."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def notebook_clean(c: Column) -> Column:
    """Lower case; characters that are no word character, blank, apostrophe or hyphen become a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s'\-]", " "), r"\s+", " "))


def normal_key(c: Column) -> Column:
    """Lower case; everything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def sentences(c: Column) -> Column:
    """Split at blanks after a full stop, question or exclamation mark; empty pieces go."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def sentence_role(s: Column) -> Column:
    """method, results, background or other, by the number of cues; ties go to the earlier kind."""
    low = F.lower(s)
    n = {role: sum((F.contains(low, F.lit(cue)).cast("int") for cue in cues), F.lit(0)) for role, cues in ROLE_CUES.items()}
    m, r, b = n["method"], n["results"], n["background"]
    return F.when((m > 0) & (m >= r) & (m >= b), "method").when((r > 0) & (r >= b), "results").when(b > 0, "background").otherwise("other")


def expand_query(c: Column) -> Column:
    """Appends aliases for known phrases; rules are (pattern, addition)."""
    c = F.trim(c)
    out = c
    for pattern, added in QUERY_EXPANSIONS:
        out = F.when(c.rlike(pattern), F.concat(out, F.lit(" " + added))).otherwise(out)
    return out


# Phrases and what is appended for them.
QUERY_EXPANSIONS = (
    (r"(?i)\bretrieval[\s-]+augmented[\s-]+generation\b", "RAG retrieval-augmented generation"),
    (r"(?i)scientific literature", "scientific papers scholarly documents"),
)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def arxiv_id(c: Column) -> Column:
    """The first arXiv id in a text without its version; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def citation_terms(c: Column) -> Column:
    """Distinct tokens of three or more characters without stop words."""
    return F.array_distinct(F.filter(content_tokens(c), lambda t: F.length(t) > 2))


def between(c: Column, start: str, end: str) -> Column:
    """Text after the first ``start`` and before the ``end`` that follows; null without ``start``."""
    at = F.instr(c, start)
    rest = F.substr(c, at + len(start))
    return F.when(at > 0, F.trim(F.substring_index(rest, end, 1)))


def heading_key(c: Column) -> Column:
    """Lower case without leading numbering and outer punctuation."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s*\d+(\.\d+)*\.?\s*", ""), r"\s+", " "), r"^[ .:\-]+|[ .:\-]+$", ""))


def output_source_ids(c: Column) -> Column:
    """Source ids that a text cites: bare arXiv ids, and bracketed lists of S-numbers or arXiv ids; distinct, sorted."""
    bare = F.regexp_extract_all(c, F.lit(r"(\d{4}\.\d{4,5})"), 1)
    inside = F.regexp_extract_all(c, F.lit(r"\[([^\[\]]+)\]"), 1)
    parts = F.flatten(F.transform(inside, lambda t: F.transform(F.split(t, r"[,;]"), lambda x: F.trim(x))))
    cited = F.filter(parts, lambda x: x.rlike(r"^(S\d+|\d{4}\.\d{4,5}(v\d+)?)$"))
    return F.array_sort(F.array_union(bare, cited))


def redact(c: Column, secrets: list[str], mark: str = "[redacted-upload]") -> Column:
    for secret in secrets:
        c = F.replace(c, F.lit(secret), F.lit(mark))
    return c


def contains_terms(c: Column, terms: list[str]) -> Column:
    """Which of the terms occur in a text, in the order given."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def initials_name(name: Column) -> Column:
    """"Surname, F. M." of a name in natural order; one word stays as it is."""
    words = F.split(F.trim(name), r"\s+")
    given = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    letters = F.array_join(F.transform(given, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    return F.when(F.size(words) > 1, F.concat(F.element_at(words, -1), F.lit(", "), letters)).otherwise(F.trim(name))


def apa_authors(authors: Column) -> Column:
    """One author; up to twenty joined with an ampersand before the last; else nineteen, an ellipsis and the last."""
    names = F.transform(F.filter(authors, lambda a: F.trim(a) != ""), initials_name)
    n = F.size(names)
    few = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.element_at(names, -1))
    many = F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", ... "), F.element_at(names, -1))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "Unknown").when(n == 1, F.get(names, F.lit(0))).when(n <= 20, few).otherwise(many)


def apa_citation(authors: Column, year: Column, title: Column, venue: Column, doi: Column, arxiv: Column, url: Column) -> Column:
    """APA entry: authors (year or n.d.). title. venue or arXiv. link of DOI, arXiv id or url."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    where = F.coalesce(filled(venue), F.when(filled(arxiv).isNotNull(), "arXiv"))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), filled(doi)), F.concat(F.lit("https://arxiv.org/abs/"), filled(arxiv)), filled(url))
    return F.concat_ws(" ", F.concat(apa_authors(authors), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(").")), F.concat(clean_text(title), F.lit(".")), F.concat(where, F.lit(".")), link)
