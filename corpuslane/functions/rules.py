"""Small fixed rules over columns: texts for search and prompts, headings, intents, relations, scores.

Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import text as X

# Section names as headings write them, in order; a heading that begins with one of them counts.
SECTION_ALIASES = {
    "introduction": ("introduction", "background", "preliminaries"),
    "method": ("method", "methods", "methodology", "approach", "model", "algorithm", "framework", "architecture", "proposed"),
    "results": ("results", "experiments", "experimental", "evaluation", "empirical", "findings"),
    "conclusion": ("conclusion", "conclusions", "future work", "summary"),
    "related_work": ("related work", "prior work", "literature review"),
    "limitations": ("limitation", "limitations"),
    "discussion": ("discussion",),
}
# Other names of expected sections.
EXPECTED_SECTIONS = {"background": "introduction", "experiments": "results", "evaluation": "results", "related work": "related_work"}
# Ways to ask for papers, and talk that asks for nothing.
TOPIC_PATTERNS = (
    r"(?i)(?:suggest|recommend|find|show|list|give\s+me)\s+(?:me\s+)?(?:(?:some|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+)?(?:research\s+)?papers?\s+(?:on|about|for|regarding)\s+(.+)",
    r"(?i)(?:what|which)\s+(?:research\s+)?papers?\s+(?:should\s+i\s+read|do\s+you\s+recommend|are\s+(?:there|recommended))\s+(?:on|about|for|regarding)\s+(.+)",
)
CHIT_CHAT = (
    r"(?i)^(?:hi|hello|hey|good\s+(?:morning|afternoon|evening))[!,. ]*$",
    r"(?i)^(?:thanks|thank\s+you|cheers)(?:\s+.*)?[!,. ]*$",
    r"(?i)^(?:(?:hi|hello|hey)[!,. ]+)?(?:i(?:'m|\s+am)\s+new(?:\s+to\s+this\s+tool)?[!,. ]*)?(?:what\s+can\s+you\s+(?:do|help\s+me\s+with)|how\s+can\s+you\s+help(?:\s+me)?|what\s+do\s+you\s+do|tell\s+me\s+about\s+(?:yourself|this\s+tool))[?!. ]*$",
    r"(?i)^(?:hi|hello|hey)[!,. ]+(?:how\s+are\s+you|what\s+can\s+you\s+(?:do|help\s+me\s+with))[?!. ]*$",
)
# Marks of a well-structured answer.
STRUCTURE_MARKS = ("Strengths", "Weaknesses", "Recommended", "Gap", "Summary", "Evidence")
HEADING = r"^\d+(?:\.\d+)*\s+[A-Z][^\n]{0,120}$"
NOTICE = "\n[... cut ...]\n"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def retrieval_text(title: Column, abstract: Column, glue: str = " ") -> Column:
    """Title and abstract as one text for search (blank between) or classifiers (". ")."""
    return F.concat(filled(title), F.lit(glue), filled(abstract))


def capped(c: Column, cap: int, keep_tail: bool = False) -> Column:
    """A text over ``cap`` characters loses its end, or its middle with ``keep_tail``; a notice marks the place."""
    half = cap // 2
    cut = F.concat(F.substring(c, 1, half), F.lit(NOTICE), F.substring(c, -half, half)) if keep_tail else F.concat(F.substring(c, 1, cap), F.lit(NOTICE))
    return F.when(F.length(c) > cap, cut).otherwise(c)


def prompt_context(title: Column, sections: Column) -> Column:
    """Title, 1,200 characters of the abstract and 800 each of method, results and limitations, a line each; missing ones left out."""
    part = lambda name, n: F.nullif(F.substring(F.element_at(sections, F.lit(name)), 1, n), F.lit(""))
    return F.concat_ws("\n", title, part("abstract", 1200), *[part(name, 800) for name in ("method", "results", "limitations")])


def first_item(c: Column) -> Column:
    """The first quoted item of a bracketed list in a string, else the trimmed string."""
    return F.when(c.startswith("["), F.regexp_extract(c, r"""^\[\s*['"]([^'"]*)""", 1)).otherwise(F.trim(c))


def normal_query(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(c, F.lit("’"), F.lit("'"))), r"\s+", " ")


def normal_topic(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[?.!]+$", ""), r"\s+", " ")


def recommendation_topic(query: Column) -> Column:
    """What papers are asked for; null where none are."""
    q = normal_query(query)
    return F.coalesce(*[F.nullif(normal_topic(F.regexp_extract(q, p, 1)), F.lit("")) for p in TOPIC_PATTERNS])


def is_chit_chat(query: Column) -> Column:
    q = normal_query(query)
    out = F.lit(False)
    for p in CHIT_CHAT:
        out = out | q.rlike(p)
    return out


def tool_call(text: Column, tool: str = "search_offline") -> Column:
    """(query, top_k) of a tool call in a text, fenced or bare; null if it calls another tool or asks for nothing; top_k is 1 to 20, 5 if missing."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*\n(.*?)\n```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)(\{.*\})", 1)
    query = F.trim(F.get_json_object(body, "$.arguments.query"))
    k = F.coalesce(F.get_json_object(body, "$.arguments.top_k").try_cast("int"), F.lit(5))
    right = (F.get_json_object(body, "$.tool") == tool) & (F.length(query) > 0)
    return F.when(right, F.struct(query.alias("query"), F.greatest(F.lit(1), F.least(k, F.lit(20))).alias("top_k")))


def section_key(heading: Column) -> Column:
    """The section that a numbered heading opens; null for others."""
    name = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(heading), r"^\d+(?:\.\d+)*\s*", ""), r"\s+", " "), r"^[ .:\-]+|[ .:\-]+$", ""))
    starts = lambda aliases: name.rlike("^(?:" + "|".join(aliases) + ")")
    return F.coalesce(F.when(name == "abstract", "abstract"), F.when(~name.rlike("^acknowledge?ments$"), F.coalesce(*[F.when(starts(a), F.lit(k)) for k, a in SECTION_ALIASES.items()])))


def section_present(sections: Column, references: Column, expected: Column) -> Column:
    """Whether an expected section, under any of its names, holds something; references are a list."""
    key = F.coalesce(*[F.when(expected == a, F.lit(k)) for a, k in EXPECTED_SECTIONS.items()], expected)
    listed = F.coalesce(F.size(references) > 0, F.lit(False))
    return F.when(expected.isin("references", "bibliography"), listed).otherwise(F.coalesce(F.length(F.trim(F.element_at(sections, key))) > 0, F.lit(False)))


def relation_by_signals(recency: Column, category: Column, sections: Column, vectors: Column) -> Column:
    return F.when(recency >= 0.8, "recent").when(recency < 0.2, "foundational").when(category >= 0.5, "same_topic").when(sections > vectors, "method_related").otherwise("similar")


def relation_by_ranks(bm25_rank: Column, vector_rank: Column) -> Column:
    """By ranks from 1, 0 for not in the list."""
    return F.when((vector_rank > 0) & ((bm25_rank == 0) | (vector_rank < bm25_rank)), "similar").otherwise("same_topic")


def relation_by_place(score: Column, place: Column) -> Column:
    """By the place in a ranking, from 0."""
    return F.when(place == 0, "method_related").when(score > 0.85, "similar").when(place <= 2, "foundational").otherwise("recent")


def reason_by_ranks(bm25_rank: Column, vector_rank: Column, title: Column) -> Column:
    # The phrases.
    terms, meaning = "strong term-frequency match with query", "high semantic similarity between query and abstract"
    why = F.when((bm25_rank > 0) & (vector_rank > 0) & (bm25_rank <= vector_rank), terms + " and semantic alignment").when(vector_rank > 0, meaning).when(bm25_rank > 0, terms).otherwise("combined BM25 and semantic retrieval signals")
    return F.concat(F.lit("Recommended due to "), why, F.lit('. Title: "'), filled(title), F.lit('".'))


def reason_by_signals(tfidf: Column, bm25: Column, vectors: Column, sections: Column) -> Column:
    """The phrase of the strongest signal; of equal ones vectors, then sections, then TF-IDF."""
    # The phrases.
    top = F.greatest(tfidf, bm25, vectors, sections)
    return F.when(vectors == top, "high semantic similarity between query and abstract").when(sections == top, "strong method/results section alignment with query topic").when(tfidf == top, "high keyword overlap with query terms").otherwise("strong term-frequency match with query")


def with_sections(docs: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """``sections``: the whole text, and the sentences of each other role joined by blanks; null where a role has none."""
    # In a column of its own, as each role reads it.
    told = docs.withColumn("_told", F.transform(X.sentences(F.col("text")), lambda s: F.struct(s.alias("s"), X.sentence_role(s).alias("role"))))
    said = lambda role: F.nullif(F.array_join(F.transform(F.filter("_told", lambda x: x["role"] == role), lambda x: x["s"]), " "), F.lit(""))
    return told.withColumn("sections", F.array("text", *[said(r) for r in roles[1:]])).drop("_told")


def section_texts(docs: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(doc_id, text) under the keys 4 * doc_id + place in ``roles``: the whole text first, then the sentences of each
    other role joined by blanks. Roles without sentences have no row; a null text has one, for the whole."""
    each = with_sections(docs.select("doc_id", "text"), roles).select("doc_id", F.posexplode("sections").alias("i", "t")).where("i = 0 or t is not null")
    return each.select((F.col("doc_id") * 4 + F.col("i")).alias("doc_id"), F.col("t").alias("text"))


def aps_author(name: Column) -> Column:
    """Initials before the surname; names that hold "and" and single words stay as they are."""
    comma = F.contains(name, F.lit(","))
    words = F.filter(F.split(F.when(comma, F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1)).otherwise(name), r"\s+"), lambda w: w != "")
    surname = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.try_element_at(words, F.lit(-1)))
    given = F.when(comma, words).otherwise(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    made = F.trim(F.concat(F.array_join(F.transform(given, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " "), F.lit(" "), surname))
    return F.when(F.contains(F.lower(name), F.lit(" and ")) | (~comma & (F.size(words) < 2)), name).otherwise(made)


def aps_authors(authors: Column) -> Column:
    """One author, two joined by "and", or the first with "et al."; "Unknown author" without any."""
    names = F.transform(F.filter(F.transform(authors, F.trim), lambda a: a != ""), aps_author)
    n = F.coalesce(F.size(names), F.lit(0))
    return F.when(n <= 0, "Unknown author").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.concat_ws(" and ", F.get(names, F.lit(0)), F.get(names, F.lit(1)))).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def structure_score(text: Column, few_shot: Column) -> Column:
    """0.55 and 0.09 for each mark of structure, at most 1; 0.08 more where examples were given."""
    hits = sum((F.contains(F.lower(text), F.lit(m.lower())).cast("int") for m in STRUCTURE_MARKS), F.lit(0))
    base = F.least(F.lit(1.0), 0.55 + 0.09 * hits)
    return F.when(few_shot, F.least(F.lit(1.0), base + 0.08)).otherwise(base)


def message_problems(messages: Column) -> Column:
    """What is wrong with a list of (role, content): too few, a missing role, empty content, another order than system, user, assistant."""
    roles = F.transform(messages, lambda m: m["role"])
    text = lambda role: F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]
    blank = lambda role: ~F.coalesce(text(role).rlike(r"\S"), F.lit(False))
    wanted = F.filter(F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), lambda r: F.array_contains(roles, r))
    found = F.array(
        F.when(F.coalesce(F.size(messages), F.lit(0)) < 2, "fewer than two messages"),
        F.when(~F.coalesce(F.array_contains(roles, "user"), F.lit(False)), "no user").when(blank("user"), "empty user"),
        F.when(~F.coalesce(F.array_contains(roles, "assistant"), F.lit(False)), "no assistant").when(blank("assistant"), "empty assistant"),
        F.when(roles != wanted, "order of roles"),
    )
    return F.filter(found, lambda p: p.isNotNull())
