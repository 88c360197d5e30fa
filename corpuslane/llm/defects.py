"""Problem 5: flag prompt-response pairs whose response is no proper answer, with the kind of defect.

Noisy labelling functions vote on each response: for the defect, against it, or not at all. For every defect an
expectation-maximization label model learns from the votes alone, without labels, how often each function is right, and
gives every response a posterior. No function is trusted by itself: one that speaks up can be overruled by others,
and several weak ones can carry a label. Which of the two latent classes is the defect is settled only by a weak prior
(functions are right more often than not, defects are the smaller part). Only the counts of vote patterns, bounded by
three to the number of functions of a defect, leave the cluster for fitting. Labels are kept where the posterior exceeds
the cutoff of the defect, so a response may keep several; :func:`one_defect` picks the one the votes favour most.
:func:`validated_cutoffs` chooses the cutoffs on all responses, into each of which every defect is planted.

The language functions learn character trigrams of every language from the responses themselves, each taken to be in
the language that its prompt wants; wrong ones are few. What is collected for that is bounded by languages times buckets.

Defined results for odd input: a null text is empty; a response whose prompt is unknown or null gets no copied or
language label; null task and error give no vote; repeated rows count once in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.runtime import cut_lineage

# Frequent words by language.
STOP_WORDS = {
    "en": "the of and is we that with to for in on are by from this as it which be an at or was were not these our",
    "de": "die der und das den eine wir nicht auf ein mit von zu dem ist für im des sich zur bei wie aus sind werden über auch einer dass zum lässt unter",
    "fr": "les des une nous et est du le la dans que pour sur par un de en avec ce ces qui sont au aux plus ne pas son sa l d",
    "es": "los las una el que en se la del con por para un de y es lo su sus como más al son este esta no sin sobre",
    "it": "il lo gli una che di della nel per con non sono del dei le questo alla si è anche",
    "pt": "os as uma que não com para em do da dos das são por mais ao também pelo foi é",
    "nl": "het een van de dat niet met voor zijn op aan wordt ook bij naar deze door",
}
# Names of languages as prompts write them.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés", "de": "german|deutsch|allemand|alemán", "fr": "french|französisch|français|francés",
    "es": "spanish|spanisch|espagnol|español", "it": "italian|italienisch|italien|italiano", "pt": "portuguese|portugiesisch|portugais|portugués", "nl": "dutch|niederländisch|néerlandais|neerlandés",
}
ASKED = r"(?iu)\b(?:reply|answer|respond|write|written|antwort\p{L}*|schreib\p{L}*|répon\p{L}*|réd\p{L}*|écri\p{L}*|respond\p{L}*|contest\p{L}*|escrib\p{L}*|escrit\p{L}*)\b[^.?!]{0,40}\b(?:in|auf|en|em|nel)\s+(?:\p{L}+\s+)?"
PLACEHOLDERS = r"(?iu)^\W*(?:no (?:output|answer|response|content)|n/?a|none|null|nil|nan|undefined|empty|tbd|todo|placeholder|lorem ipsum|keine (?:ausgabe|antwort)|sans réponse|sin respuesta)\W*$"
REFUSING = (
    r"(?iu)(?:\b(?:can ?not|can['’]t|won['’]t|will not|unable to|not able to|must decline|decline to|not possible for me|have to pass|refuse to|outside what i am|not permitted|not allowed)\b"
    r"|\bkann\b.{0,60}\bnicht\b|\bablehnen\b|\bdarf\b.{0,60}\b(?:nicht|keine?)\b|\bnicht möglich\b|\bnicht in der lage\b|\bkeine antwort geben\b"
    r"|\bne (?:peux|puis) pas\b|\bm['’]est impossible\b|\bdécliner\b|\bpas en mesure\b|\brefuser\b"
    r"|\bno puedo\b|\bno me es posible\b|\brechazar\b|\bno estoy en condiciones\b|\bdeclinar\b)"
)
#: Every match of REFUSING holds one of these, which are looked for first as that costs far less.
REFUSING_STEMS = (
    "cannot", "can not", "can't", "can’t", "won't", "won’t", "will not", "unable to", "not able", "decline", "not possible", "have to pass", "refuse", "outside what", "not permitted", "not allowed", "kann", "ablehnen", "darf", "nicht möglich",
    "nicht in der lage", "keine antwort", "ne peux", "ne puis", "impossible", "décliner", "pas en mesure", "no puedo", "no me es", "rechazar", "no estoy", "declinar",
)
REFUSAL_OPENERS = (
    r"(?iu)^\W*(?:i['’]?m (?:very |really )?sorry|sorry|i am sorry|apolog\p{L}+|unfortunately|regrettably|as an? (?:ai|assistant|language model)|i (?:cannot|can['’]t|won['’]t|must|have to|am not able|am unable)|this is something|answering this|it is not possible"
    r"|leider|es tut mir leid|tut mir leid|entschuldig\p{L}+|als (?:ki|assistent)\p{L}*|bedauerlicherweise|je suis désolée?|désolée?|malheureusement|en tant qu|navrée?|je (?:ne|dois)|il m"
    r"|lo siento|lamentablemente|como (?:asistente|ia)|desafortunadamente|disculp\p{L}+|me temo|no puedo|debo)"
)
COURTESY = (
    r"(?iu)(?:thank you|let me know|please (?:consult|rephrase|ask|contact)|you may wish|vielen dank|danke|bitte|merci|veuillez|n['’]hésitez|gracias|por favor|summary|key_findings)"
)
#: A last line that lists sources or labels is whole without a stop.
LISTED = r"(?u)^\s*[*_]*\p{L}+[*_]*:[*_]*\s*\[?[A-Z]?\d+\]?(?:\s*[,;]\s*\[?[A-Z]?\d+\]?)*$"
OPEN_END = r"[…–—\-,;:(\[{]$|\.\.\.$"

#: Cutoffs where nothing can be planted.
CUTOFFS = {"empty": 0.5, "copied_question": 0.5, "refusal": 0.5, "truncated": 0.5, "other_language": 0.5}
#: Order of defects; it decides only between labels that the votes favour equally.
PRECEDENCE = ("empty", "copied_question", "refusal", "truncated", "other_language")
EM_ROUNDS = 50
#: Ends of lines are judged by rates: two words that end a line less than SELDOM times as often as words at large are
#: strange, those that do as often are sound, and between the two there is no vote. LEAN uses' worth of the coarser rate
#: is mixed in. An unknown last word is strange where at most RARELY_NEW of sound ends have a word that is nowhere else.
LEAN, SELDOM, RARELY_NEW = 2.0, 0.25, 0.02
#: A sentence is a formula where it is said under so large a share of the prompts, and under several of them.
FORMULA_SHARE = 0.02
#: Cutoffs are chosen from GRID.
GRID = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
EMPTY_TEXTS = ("", " \n ", "N/A", "{}", "[]", "null", "```\n```", "...", '{"summary": "", "key_findings": []}', "# Summary\n\n# Findings\n")
REFUSAL_TEXTS = (
    "I'm sorry, but I can't assist with that request.", "I am unable to answer this question.", "As a language model I cannot do this. Please contact an expert.", "Unfortunately I must decline.", "Sorry, that is not something I can help with.",
    "Es tut mir leid, dabei kann ich nicht helfen.", "Diese Frage darf ich nicht beantworten.", "Je suis désolé, je ne peux pas répondre à cette question.", "Je ne suis pas en mesure de vous aider.", "Lo siento, no puedo ayudarte con eso.",
    "Mi dispiace, ma non posso rispondere a questa domanda.", "Desculpe, não posso ajudar com isso.",
)
BUCKETS = 1 << 15
#: A language is learned from at least so many trigrams.
LEAST_TRIGRAMS = 20_000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _plain(c: Column) -> Column:
    """Lower-case words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


#: Characters without width, and those that count as blank around an answer.
WIDTHLESS, BLANKS = "\u200b\u200c\u200d\u2060\ufeff", " \t\n\x0b\f\r\u0020"


def bare_answer(text: Column) -> Column:
    """A response without hidden thoughts, characters without width and outer blanks; null gives the empty string.

    Only texts that hold a thought meet the regular expression."""
    c = F.coalesce(text, F.lit(""))
    thoughtless = F.regexp_replace(c, rf"(?is)<think>.*?(?:</think>|$)|[{WIDTHLESS}]", "")
    return F.btrim(F.when(F.contains(F.lower(c), F.lit("<think>")), thoughtless).otherwise(F.translate(c, WIDTHLESS, "")), F.lit(BLANKS))


def prepare(generations: DataFrame, prompts: DataFrame) -> DataFrame:
    """Responses beside their prompts with the derived texts that the labelling functions read; ``h`` tells versions of a row apart."""
    p = prompts.where(F.col("prompt_id").isNotNull()).groupBy("prompt_id").agg(F.max(F.struct("prompt_text", F.col("lang").alias("prompt_lang"))).alias("_p"))
    asked = F.coalesce(*[F.when(F.col("prompt_text").rlike(ASKED + rf"(?:{names})\b"), F.lit(lang)) for lang, names in LANGUAGE_NAMES.items()])
    p = p.select("prompt_id", "_p.*").withColumns({"prompt_plain": _plain(F.col("prompt_text")), "wanted_lang": F.coalesce(asked, F.lower(F.trim("prompt_lang")))})
    planted = F.col("planted") if "planted" in generations.columns else F.lit(None).cast("string").alias("planted")
    copies = F.col("copies") if "copies" in generations.columns else F.lit(1).cast("bigint").alias("copies")
    sound = F.coalesce(F.col("sound"), F.lit(False)).alias("sound") if "sound" in generations.columns else F.lit(False).alias("sound")
    g = generations.select("generation_id", "prompt_id", "error", "text", planted, copies, sound).join(p.select("prompt_id", "prompt_plain", "wanted_lang", F.lit(True).alias("_known")), "prompt_id", "left")
    g = g.withColumn("sound", F.col("sound") & F.col("_known").isNotNull()).drop("_known")
    g = g.withColumn("h", F.xxhash64("text", "planted")).withColumn("answer", bare_answer(F.col("text")))
    # Content without keys of objects, fences, headings and labels.
    content = F.regexp_replace("answer", r'"[A-Za-z_]+"\s*:', " ")
    content = F.regexp_replace(content, r"(?m)^\s*```\w*\s*$|^\s*#{1,6}\s.*$|^\s*\*\*[^*\n]+\*\*:?\s*$", " ")
    g = g.withColumn("content", content).withColumn("answer_plain", _plain(F.col("answer"))).withColumn("content_plain", _plain(F.col("content")))
    holds = F.coalesce((F.length("prompt_plain") > 0) & F.contains("answer_plain", F.col("prompt_plain")), F.lit(False))
    without = lambda c: F.when(holds, F.replace(F.col(c), F.col("prompt_plain"), F.lit(" "))).otherwise(F.col(c))
    g = g.withColumn("holds_prompt", holds).withColumn("rest", F.trim(F.regexp_replace(F.trim(without("answer_plain")), r"^(?:question|prompt|query|task|frage|pregunta|aufgabe)\b", "")))
    said = F.regexp_replace("content", r"[\"{}\[\],:]", " ")
    low = F.lower("content")
    stems = F.lit(False)
    for stem in REFUSING_STEMS:
        stems = stems | F.contains(low, F.lit(stem))
    refusing = stems & F.col("content").rlike(REFUSING)
    sentences = F.filter(F.split(said, r"(?<=[.!?])\s+|\n+"), lambda x: x.rlike(r"\p{L}"))
    others = F.array_join(F.filter(sentences, lambda x: ~x.rlike(REFUSING) & ~x.rlike(COURTESY)), " ")
    # What is left beside refusing and polite sentences; the language of a refusal is no matter.
    g = g.withColumns({"refuses": refusing, "others": F.when(refusing, others)})
    return g.withColumn("speech", F.when(F.col("refuses"), F.lower("others")).otherwise(without("content_plain"))).drop("text", "content_plain")


def _line_kind(line: Column) -> Column:
    """How a line opens: its list mark with the two words after it, or the kind of source line or prose."""
    opener = F.regexp_extract(line, r"^\s*(?:[-*•]|\d+[.)])\s+(\S+\s+\S+)", 1)
    return F.when(line.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+\[S?\d"), F.lit("[source]")).when(opener != "", F.lower(opener)).when(line.rlike(r"^\s*\|"), F.lit("[row]")).otherwise(F.lit("[prose]"))


ENDED = r"(?:(?<!\.)\.|[!?])[\"'”’»)\]*_]*(?:\s*\[S?\d+(?:\s*,\s*S?\d+)*\][.]?)*$"


def _tokens(line: Column) -> Column:
    """Words of a line in lower case, numbers as #."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(line), r"\d+(?:[.,]\d+)*", "#"), F.lit(r"([\p{L}#][\p{L}#'’\-]*)"), 1)


def line_habits(g: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What lines that are surely whole look like: how often each kind ends in a stop, and how often words end lines.

    Only lines before the last of a response count, and sentences inside lines, as neither can be cut off. Equal ones
    count once, so copies of a corpus have the habits of one. Gives kinds (kind, stops), pairs of neighbouring words
    (ending, pair_n, pair_ends), words (end_word, word_n, word_ends) and one row (base, novelty): the share of all
    words that end a line, and the share of ends with a word that is nowhere else.
    """
    # Lines of all responses; of the last one only the sentences before its end. Text moves once, to drop repeats.
    last_inner = F.slice(F.split(F.element_at("_l", -1), r"(?<=[.!?])\s+"), 1, F.greatest(F.size(F.split(F.element_at("_l", -1), r"(?<=[.!?])\s+")) - 1, F.lit(0)))
    lines = g.select(F.filter(F.split("answer", r"\n"), lambda x: x.rlike(r"\S")).alias("_l")).where(F.size("_l") > 0)
    whole = F.transform(F.slice("_l", 1, F.size("_l") - 1), lambda x: F.struct(x.alias("line"), F.lit(True).alias("whole")))
    units = lines.select(F.explode(F.concat(whole, F.transform(last_inner, lambda x: F.struct(x.alias("line"), F.lit(False).alias("whole"))))).alias("u")).select("u.*").distinct()
    kinds = units.where("whole").groupBy(_line_kind(F.col("line")).alias("kind")).agg(((F.count_if(F.col("line").rlike(ENDED)) + 1) / (F.count("*") + 2)).alias("stops"))
    words = units.select(F.explode(F.split("line", r"(?<=[.!?])\s+")).alias("line")).select(_tokens(F.col("line")).alias("t")).where(F.size("t") > 0)
    uses = words.select(F.posexplode("t").alias("i", "end_word"), "t").select("end_word", F.when(F.col("i") > 0, F.concat_ws(" ", F.get("t", F.col("i") - 1), F.col("end_word"))).otherwise("").alias("ending"), (F.col("i") == F.size("t") - 1).alias("ends"))
    counts = cut(uses.groupBy("ending", "end_word").agg(F.count("*").alias("pair_n"), F.count_if("ends").alias("pair_ends")))
    by_word = counts.groupBy("end_word").agg(F.sum("pair_n").alias("word_n"), F.sum("pair_ends").alias("word_ends"))
    rates = by_word.agg((F.sum("word_ends") / F.sum("word_n")).alias("base"), (F.sum(F.when(F.col("word_n") == 1, F.col("word_ends")).otherwise(0)) / F.sum("word_ends")).alias("novelty"))
    return kinds, counts.where("ending <> ''").drop("end_word"), by_word, rates


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every trigram of letters and blanks of ``texts``, the text it stands in, and all code points."""
    codes = np.frombuffer(" \n ".join(texts).join((" ", " ")).encode("utf-32-le"), dtype=np.uint32)
    owner = np.cumsum(codes == 10)
    codes = np.where((codes >= 48) & (codes < 58) | (codes == 10), 32, codes)
    keep = (codes[1:-1] != 32) | (codes[:-2] != 32)
    a, b, c = codes[:-2].astype(np.uint64), codes[1:-1].astype(np.uint64), codes[2:].astype(np.uint64)
    bucket = ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77) + c * np.uint64(0xC2B2AE3D)) >> np.uint64(13)) & np.uint64(BUCKETS - 1)
    return bucket[keep].astype(np.int64), owner[1:-1][keep], codes


def learn_languages(g: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the logarithms of their smoothed trigram shares (languages by BUCKETS)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, part in frame.groupby("wanted_lang"):
                made = np.bincount(_trigrams(part["speech"].tolist())[0], minlength=BUCKETS)
                totals[lang] = totals.get(lang, 0) + made
        for lang, t in totals.items():
            at = np.nonzero(t)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": t[at]})

    # One row for a language and bucket leaves each task, so what is summed and collected is bounded.
    plain = F.lower(F.regexp_replace("answer", r'"[A-Za-z_]+"\s*:', " ")).alias("speech")
    told = g.where("wanted_lang is not null and answer <> ''").select("wanted_lang", F.translate(plain, "\n\r\t", "   ").alias("speech")).mapInPandas(count, "lang string, bucket bigint, n bigint")
    rows = told.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(x for x, n in rows.groupby("lang")["n"].sum().items() if n >= LEAST_TRIGRAMS)
    table = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        part = rows[rows["lang"] == lang]
        table[i, part["bucket"].to_numpy()] += part["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


# The ranges of letters of scripts.
SCRIPTS = ((0x41, 0x250, "latin"), (0x370, 0x400, "greek"), (0x400, 0x530, "cyrillic"), (0x590, 0x600, "hebrew"), (0x600, 0x780, "arabic"), (0x900, 0xE00, "indic"), (0xE00, 0xE80, "thai"), (0x3040, 0x3100, "kana"), (0x4E00, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"))


HEARD = "struct<lead:double,loss:double,script:string>"


def hear(model: tuple[list[str], np.ndarray]):
    """A column function of (speech, wanted language): the lead of the likeliest language over the wanted one in nats a
    trigram, how much more the wanted language loses on the speech than on texts of its own, and the main script."""
    langs, table = model
    # The entropy of a language is what its own texts lose on average.
    own = -(np.exp(table) * table).sum(axis=1) if langs else np.zeros(0)
    starts, ends = np.array([s[0] for s in SCRIPTS]), np.array([s[1] for s in SCRIPTS])

    def run(speech: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in speech]
        n = len(texts)
        bucket, owner, codes = _trigrams(texts)
        many = np.maximum(np.bincount(owner, minlength=n)[:n], 1)
        scores = np.stack([np.bincount(owner, weights=table[i][bucket], minlength=n)[:n] / many for i in range(len(langs))]) if langs else np.zeros((0, n))
        at = np.searchsorted(starts, codes, side="right") - 1
        inside = (at >= 0) & (codes < ends[np.maximum(at, 0)]) & ((codes < 0x5B) | (codes > 0x60)) & ((codes < 0x7B) | (codes > 0xBF))
        text_of = np.minimum(np.searchsorted(np.cumsum([len(t) + 3 for t in texts]), np.nonzero(inside)[0], side="right"), n - 1)
        letters = np.bincount(text_of * len(SCRIPTS) + at[inside], minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
        script = [SCRIPTS[k][2] if letters[i, k] else None for i, k in enumerate(letters.argmax(axis=1))]
        at_wanted = [langs.index(w) if w in langs and len(t) >= 20 else -1 for w, t in zip(wanted, texts)]
        lead = [float(scores[:, i].max() - scores[w, i]) if w >= 0 else None for i, w in enumerate(at_wanted)]
        loss = [float(-scores[w, i] - own[w]) if w >= 0 else None for i, w in enumerate(at_wanted)]
        return pd.DataFrame({"lead": pd.array(lead, dtype="Float64"), "loss": pd.array(loss, dtype="Float64"), "script": script})

    return F.pandas_udf(run, HEARD)


def formulas(g: DataFrame) -> DataFrame:
    """(generation_id, h): responses shorter than twice their prompt that say nothing but what is said, in such responses, under many prompts."""
    parts = F.filter(F.split(F.regexp_replace("content", r"[\"{}\[\]]", " "), r"(?<=[.!?])\s+|\n+"), lambda x: x.rlike(r"\p{L}"))
    said = g.where((F.length("answer_plain") > 0) & (F.length("answer_plain") < 2 * F.length("prompt_plain"))).select("generation_id", "h", "prompt_id", parts.alias("_s"))
    each = said.select("generation_id", "h", "prompt_id", F.explode(F.transform("_s", lambda x: F.xxhash64(_plain(x)))).alias("s"))
    prompts = g.agg(F.count_distinct("prompt_id").alias("_p"))
    common = each.select("s", "prompt_id").distinct().groupBy("s").agg(F.count("*").alias("n")).crossJoin(F.broadcast(prompts))  # one row
    common = common.where((F.col("n") >= 3) & (F.col("n") >= FORMULA_SHARE * F.col("_p"))).select("s", F.lit(1).alias("known"))
    judged = each.distinct().join(common, "s", "left").groupBy("generation_id", "h").agg((F.count("known") == F.count("*")).alias("all"))
    return judged.where("all").select("generation_id", "h")


def _stop_hits(words: Column) -> dict[str, Column]:
    return {lang: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed.split()]))) for lang, listed in STOP_WORDS.items()}


KEY = ["generation_id", "h"]


def read_features(g: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Slim rows of what the functions read, without the texts; ``model`` comes from :func:`learn_languages`."""
    last = F.element_at(F.filter(F.split("answer", r"\n"), lambda x: x.rlike(r"\S")), -1)
    g = g.withColumn("last_line", F.when(F.length("answer") > 0, F.rtrim(last)))
    # An answer may open with words, such as the question, and go on as a JSON object.
    g = g.withColumn("tail", F.coalesce(F.regexp_extract("answer", r"(?s)\n\s*(\{\s*\".*)$", 1), F.lit("")))
    has_prompt = F.length("prompt_plain") > 0
    ratio = F.length("answer_plain") / F.length("prompt_plain")
    near = has_prompt & ratio.between(0.5, 1.5)
    p_words, a_words = F.array_distinct(F.split("prompt_plain", " ")), F.array_distinct(F.split("answer_plain", " "))
    g = g.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("shared", F.when(F.col("near"), F.size(F.array_intersect(p_words, a_words)) / F.size(F.array_union(p_words, a_words))))
    topic = F.filter(p_words, lambda w: F.length(w) >= 5)
    heads = F.array_join(F.slice(F.split("prompt_plain", " "), 1, 4), " ")
    json = F.col("answer").rlike(r"^(?:```\w*\s*)?[{\[]") | (F.col("tail") != "")
    body = F.regexp_replace(F.when(F.col("tail") != "", F.col("tail")).otherwise(F.col("answer")), r"^```\w*\s*|\s*```$", "")
    listed = F.col("last_line").rlike(r"^\s*#{1,6}\s|^\s*\*\*[^*]+\*\*:?\s*$|^\s*```|^\s*\|.*\|\s*$") | F.col("last_line").rlike(LISTED)
    t = _tokens(F.col("last_line"))
    hits = F.array(*[F.struct(n.alias("n"), F.lit(lang).alias("lang")) for lang, n in _stop_hits(F.split("speech", r"[^\p{L}\p{N}]+")).items()])
    return g.select(
        *KEY, "planted", "copies", "sound", "wanted_lang", hear(model)("speech", "wanted_lang").alias("heard"), "refuses", "near", "shared", json.alias("json"),
        F.when(json, F.try_parse_json(body).isNull()).alias("broken"),
        F.coalesce(has_prompt, F.lit(False)).alias("has_prompt"), F.coalesce(~ratio.between(0.33, 3.0), F.lit(False)).alias("far"),
        F.col("content").rlike(r"[\p{L}\p{N}]").alias("has_content"), F.col("content").rlike(r"\p{L}{2}").alias("has_words"),
        F.col("answer").rlike(PLACEHOLDERS).alias("placeholder"), F.lower(F.coalesce("error", F.lit(""))).alias("err"),
        F.when(F.col("near") & (F.col("shared") > 0.3), 1 - F.levenshtein("answer_plain", "prompt_plain") / F.greatest(F.length("answer_plain"), F.length("prompt_plain"))).when(F.col("near"), 0.0).alias("alike"),
        F.when(F.col("holds_prompt"), F.length("rest") <= F.length("prompt_plain") * 0.15).alias("only_prompt"),
        F.when(has_prompt & (F.length(heads) >= 8), F.startswith(F.regexp_replace("answer_plain", r"^(?:question|prompt|query|task|frage|pregunta|aufgabe) ", ""), heads)).alias("opens_alike"),
        F.coalesce(F.col("content").rlike(REFUSAL_OPENERS), F.lit(False)).alias("opener"),
        F.when(F.col("refuses"), F.regexp_count(F.col("others"), F.lit(r"[\p{L}\p{N}]+")) <= 0.3 * F.regexp_count(F.col("answer_plain"), F.lit(r"\S+"))).otherwise(False).alias("alone"),
        F.when(F.col("refuses"), F.regexp_count(F.col("others"), F.lit(r"[\p{L}\p{N}]+"))).alias("other_words"),
        F.when(has_prompt & (F.length("answer_plain") > 0), 2 * F.when(F.col("refuses"), F.length("others")).otherwise(F.length("answer_plain")) < F.length("prompt_plain")).alias("short"),
        F.when(F.size(topic) > 0, ~F.arrays_overlap(topic, a_words)).alias("off_topic"),
        ((F.size(F.split("answer", "```")) - 1)).alias("marks"),
        (json | listed).alias("framed"), F.col("last_line").rlike(ENDED).alias("stops_here"), F.col("last_line").rlike(r"\d\.$").alias("number_last"), F.col("last_line").rlike(OPEN_END).alias("open_end"),
        _line_kind(F.col("last_line")).alias("kind"), F.try_element_at(t, F.lit(-1)).alias("end_word"), F.when(F.size(t) > 1, F.concat_ws(" ", F.try_element_at(t, F.lit(-2)), F.try_element_at(t, F.lit(-1)))).alias("ending"),
        F.array_sort(hits, lambda a, b: b["n"] - a["n"]).alias("hits"), F.regexp_count(F.col("speech"), F.lit(r"[\p{L}\p{N}]+")).alias("n_words"),
    )


def with_votes(g: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(generation_id, planted, votes of every labelling function: 1 for the defect, 0 against it, null for no vote).

    Planted responses get votes like all others, but the corpus is learned from the real ones only.
    """
    real = g.where("planted is null")
    return cast_votes(cut(read_features(g, learn_languages(real))), line_habits(real, cut), cut(formulas(real)))


def cast_votes(x: DataFrame, habits: tuple[DataFrame, DataFrame, DataFrame, DataFrame], formula: DataFrame) -> DataFrame:
    """The votes of responses by their stored features and by what the corpus taught."""
    kinds, pairs, by_word, rates = habits
    col = F.col
    yes, no = F.lit(1), F.lit(0)
    says = lambda c: F.when(F.coalesce(c, F.lit(False)), yes).otherwise(no)
    some = col("has_content")
    prose = col("kind") == "[prose]"
    # Only the few ends in question meet the tables of words; no text is joined.
    in_question = some & ~col("placeholder") & (~col("framed") & ~col("stops_here") & ~prose | ~col("json") & col("number_last"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    word_share = (count("word_ends") + LEAN * col("base")) / (count("word_n") + LEAN)
    share = (count("pair_ends") + LEAN * word_share) / (count("pair_n") + LEAN)
    ends_so = F.when(count("word_n") == 0, F.when(col("novelty") <= RARELY_NEW, yes)).when(share < col("base") * SELDOM, yes).when(share >= col("base"), no)
    ends = x.where(in_question & col("end_word").isNotNull()).select(*KEY, "end_word", F.coalesce("ending", F.lit("")).alias("ending")).distinct()
    ends = ends.join(by_word, "end_word", "left").join(pairs, "ending", "left").crossJoin(F.broadcast(rates)).select(*KEY, ends_so.alias("ends_so"))  # one row
    open_kinds = x.where(some & ~col("framed") & ~prose & ~col("stops_here")).select(*KEY, "kind").distinct().join(kinds, "kind").where("stops > 0.8").select(*KEY, F.lit(True).alias("habit"))
    x = x.join(ends, KEY, "left").join(open_kinds, KEY, "left").join(formula.withColumn("formula", F.lit(True)), KEY, "left")

    copied = F.coalesce((col("alike") >= 0.72) | (col("shared") >= 0.8), F.lit(False)) | F.coalesce(col("only_prompt"), F.lit(False))
    unfinished = F.when(~col("framed") & some & ~col("placeholder") & (prose | F.coalesce(col("habit"), F.lit(False)) | col("stops_here")), says(~col("stops_here")))
    first, second = F.get("hits", F.lit(0)), F.get("hits", F.lit(1))
    of_wanted = F.get(F.filter("hits", lambda z: z["lang"] == col("wanted_lang")), F.lit(0))["n"]
    known = of_wanted.isNotNull() & (first["n"] >= 2)
    lead, script = col("heard.lead"), col("heard.script")
    spoken = lead.isNotNull()
    votes: dict[str, dict[str, Column]] = {
        "empty": {"no_content": says((~some | col("placeholder")) & ~copied), "placeholder": says(col("placeholder")), "no_words": says(~col("has_words") & ~copied | col("placeholder")), "error_empty": says(col("err").rlike("empty"))},
        "copied_question": {"edit": F.when(col("near") | col("far"), says(col("alike") >= 0.72)), "words": F.when(col("near") | col("far"), says(col("shared") >= 0.8)), "whole": F.when(col("has_prompt"), says(col("only_prompt"))), "opening": F.when(col("has_prompt"), says(col("opens_alike")))},
        "refusal": {
            "phrase": F.when(some, says(col("refuses"))), "alone": F.when(some, says(col("alone"))), "nothing_else": F.when(some, says(col("other_words") <= 6)), "opener": says(col("opener")), "short": F.when(~copied, says(col("short") & some)), "formula": F.when(some, says(col("formula"))),
            "off_topic": F.when(some, says(col("off_topic"))), "error_filter": says(col("err").rlike("filter|refus")),
        },
        "truncated": {
            "broken_json": F.when(col("json") & some, says(col("broken"))), "open_fence": F.when((col("marks") > 0) & some, says(col("marks") % 2 == 1)), "unfinished": F.when(~copied, unfinished),
            "strange_end": F.when(~col("framed") & some & ~copied & ~col("stops_here") & ~prose, col("ends_so")), "number_end": F.when(~col("json") & col("number_last") & ~copied, col("ends_so")),
            "open_end": F.when(~col("json") & some & ~copied, says(col("open_end"))), "error_length": says(col("err").rlike("length|limit|closed")),
        },
        "other_language": {
            "stop_words": F.when(known & ~copied, says((first["lang"] != col("wanted_lang")) & (first["n"] - of_wanted >= 2))), "ngrams": F.when(spoken & ~copied, says(lead > 0.05)),
            "unlike": F.when(spoken & ~copied, says(col("heard.loss") > 1.5)), "few_known": F.when(of_wanted.isNotNull() & (col("n_words") >= 8) & ~copied, says(of_wanted * 12 < col("n_words"))), "script": F.when(script.isNotNull() & col("_main").isNotNull() & ~copied, says(script != col("_main"))),
        },
    }
    scripts = x.where("planted is null and heard.script is not null and wanted_lang is not null").groupBy("wanted_lang", F.col("heard.script").alias("script")).agg(F.count("*").alias("n")).groupBy("wanted_lang").agg(F.max_by("script", F.struct("n", "script")).alias("_main"))
    x = x.join(scripts, "wanted_lang", "left")  # a row a language
    columns = [v.alias(f"{d}__{name}") for d, fs in votes.items() for name, v in fs.items()]
    return x.select("generation_id", "planted", "copies", "sound", *columns)


#: Functions that see few cases of their defect by their nature; their silence says little.
QUIET = ("placeholder", "error_empty", "formula", "error_filter", "open_end", "error_length", "script", "unlike")
QUIET_HIT_PRIOR = 0.3
#: Prior of a function's hits and of its false alarms, as shares of the rows that it speaks on, and the prior share of defects.
HIT_PRIOR, NOISE_PRIOR, PRIOR_SHARE = 0.8, 0.02, 0.02
#: Weight of these priors: so many responses and a share of all, of hits a share of that; a handful of responses teaches little.
PRIOR_ROWS, PRIOR_WEIGHT, HIT_WEIGHT = 50, 0.002, 0.1


class LabelModel:
    """What EM has learned about the functions of one defect."""

    def __init__(self, names: list[str]):
        self.names, self.share = names, PRIOR_SHARE
        self.hit = self.first_hit = np.array([QUIET_HIT_PRIOR if n in QUIET else HIT_PRIOR for n in names])
        self.noise = np.full(len(names), NOISE_PRIOR)

    def odds(self, patterns: list[str]) -> np.ndarray:
        """Log odds of the defect for vote patterns (strings of 1, 0 and -); a silent function says nothing."""
        votes = np.array([list(v) for v in patterns]).reshape(len(patterns), len(self.names))
        gain = np.where(votes == "1", np.log(self.hit / self.noise), np.log((1 - self.hit) / (1 - self.noise)))
        return math.log(self.share / (1 - self.share)) + np.where(votes == "-", 0.0, gain).sum(axis=1)

    def fit(self, patterns: list[tuple[str, int]], rounds: int = EM_ROUNDS) -> LabelModel:
        """EM over (pattern, count); votes are taken as independent given the defect.

        The priors are weak: they say which class is the defect, and keep rates off 0 and 1.
        """
        total = sum(n for _, n in patterns)
        if not total:
            return self
        keys = [v for v, _ in patterns]
        votes = np.array([list(v) for v in keys]).reshape(len(keys), len(self.names))
        n = np.array([c for _, c in patterns], dtype=float)[:, None]
        speaks, for_it = votes != "-", votes == "1"
        weight = PRIOR_WEIGHT * total + PRIOR_ROWS
        # Defects are rare, so how often a function speaks up at all is a first guess of its false alarms.
        first = (NOISE_PRIOR * PRIOR_ROWS + (n * (for_it & speaks)).sum(axis=0)) / (PRIOR_ROWS + (n * speaks).sum(axis=0))
        self.noise = np.minimum(first, self.first_hit)
        for _ in range(rounds):
            post = 1 / (1 + np.exp(-np.clip(self.odds(keys), -500, 500)))[:, None]
            self.share = float((n * post).sum() + PRIOR_SHARE * weight) / (total + weight)
            said = lambda p: ((n * p * (for_it & speaks)).sum(axis=0), (n * p * speaks).sum(axis=0))
            (yes, of), (false, rest) = said(post), said(1 - post)
            few = weight * HIT_WEIGHT
            self.hit, self.noise = (yes + self.first_hit * few) / (of + few), (false + np.minimum(first, NOISE_PRIOR) * weight) / (rest + weight)
        return self


def _functions(votes: DataFrame, defect: str) -> list[str]:
    return [c for c in votes.columns if c.startswith(f"{defect}__")]


def coded_votes(votes: DataFrame) -> DataFrame:
    """(generation_id, planted, copies, sound, defect, pattern)."""
    code = lambda d: F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _functions(votes, d)])
    own = ["generation_id", "planted", "copies", "sound"]
    return votes.select(*own, F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), code(d).alias("pattern")) for d in PRECEDENCE])).alias("_v")).select(*own, "_v.*")


def pattern_odds(votes: DataFrame) -> tuple[pd.DataFrame, dict[str, LabelModel]]:
    """(defect, pattern, planted, n, odds) for all patterns that occur, and the models fitted on those of real responses."""
    counted = coded_votes(votes).groupBy("defect", "pattern", "planted").agg(F.sum("copies").alias("n"), F.count_if("sound").alias("sound")).toPandas()  # bounded: 3 to the number of functions of a defect
    # Responses that took defects stand for themselves as the unchanged ones.
    unchanged = counted[counted["planted"].isna() & (counted["sound"] > 0)].assign(planted="none")
    counts = pd.concat([counted, unchanged.assign(n=unchanged["sound"])], ignore_index=True).drop(columns="sound")
    models = {}
    counts["odds"] = 0.0
    for d in PRECEDENCE:
        own = counts["defect"] == d
        real = counts[own & counts["planted"].isna()]
        models[d] = LabelModel([c.partition("__")[2] for c in _functions(votes, d)]).fit(list(zip(real["pattern"], real["n"])))
        if own.any():
            counts.loc[own, "odds"] = models[d].odds(list(counts.loc[own, "pattern"]))
    return counts, models


def validated_cutoffs(counts: pd.DataFrame) -> pd.DataFrame:
    """(defect, cutoff, precision, recall, planted): per defect the cutoff of GRID of best F1 on the planted responses.

    Responses planted with the defect are its cases; those planted with other defects, and those planted unchanged, are
    not. Of equally good cutoffs the middle one counts; without planted cases CUTOFFS hold.
    """
    rows = []
    for d in PRECEDENCE:
        seen = counts[(counts["defect"] == d) & counts["planted"].notna()]
        case = seen["planted"] == d
        tried = []
        for c in GRID:
            said = seen["odds"] > math.log(c / (1 - c))
            right, claimed, cases = seen.loc[said & case, "n"].sum(), seen.loc[said, "n"].sum(), seen.loc[case, "n"].sum()
            tried.append((2 * right / (claimed + cases) if claimed + cases else 0.0, c, right / claimed if claimed else 0.0, right / cases if cases else 0.0))
        best = [t for t in tried if t[0] == max(t[0] for t in tried)]
        _, c, precision, recall = best[len(best) // 2]
        cases = int(seen.loc[case, "n"].sum())
        rows.append((d, float(c) if cases else CUTOFFS[d], float(precision), float(recall), cases))
    return pd.DataFrame(rows, columns=["defect", "cutoff", "precision", "recall", "planted"])


def _takes() -> Column:
    """Whether a response is long enough to have defects planted into it."""
    return F.coalesce((F.length("text") >= 80) & F.col("prompt_id").isNotNull(), F.lit(False))


def plant(generations: DataFrame, prompts: DataFrame, rows: int | None = None) -> DataFrame:
    """All responses (with ``rows`` only so many, by hash), each unchanged ("none") and with every defect planted that it can take.

    Truncated: cut off at 0.3 to 0.9 of its length. Other language: under a prompt in another language than its own.
    Copied: the prompt, plain, quoted or without a word. Empty and refusal: fixed texts.
    """
    p = prompts.where("prompt_id is not null").groupBy("prompt_id").agg(F.max(F.struct("prompt_text", F.lower(F.trim("lang")).alias("lang"))).alias("_p")).select("prompt_id", "_p.prompt_text", "_p.lang")
    # Prompts that ask for a language of their own take no answer in a wrong one.
    p = p.withColumn("lang", F.when(~F.col("prompt_text").rlike(ASKED), F.col("lang")))
    chosen = generations.where(_takes()).select("generation_id", "prompt_id", "error", "text")
    if rows is not None:
        chosen = chosen.orderBy(F.xxhash64("generation_id", F.lit(5)), "text").limit(rows)
    base = chosen.join(p, "prompt_id").withColumn("turn", F.pmod(F.xxhash64("generation_id"), F.lit(60)))
    made = {
        "none": F.col("text"),
        "truncated": F.substr(F.col("text"), F.lit(1), (F.length("text") * (0.3 + 0.01 * F.col("turn"))).cast("int")),
        "copied_question": F.when(F.col("turn") < 20, F.col("prompt_text")).when(F.col("turn") < 40, F.concat(F.lit('"'), F.col("prompt_text"), F.lit('"'))).otherwise(F.regexp_replace("prompt_text", r"^(\S+\s+\S+)\s+\S+", "$1")),
        "empty": F.get(F.array(*[F.lit(t) for t in EMPTY_TEXTS]), F.col("turn") % len(EMPTY_TEXTS)),
        "refusal": F.get(F.array(*[F.lit(t) for t in REFUSAL_TEXTS]), F.col("turn") % len(REFUSAL_TEXTS)),
    }
    direct = base.select("generation_id", "prompt_id", "error", F.explode(F.array(*[F.struct(F.lit(k).alias("planted"), c.alias("text")) for k, c in made.items()])).alias("_m")).select("generation_id", "prompt_id", "error", "_m.*")
    # Prompts are numbered inside their language; each response goes to one of another language.
    numbered = p.where("lang is not null").select(F.col("prompt_id").alias("_to"), F.col("lang").alias("_l"), F.row_number().over(Window.partitionBy("lang").orderBy("prompt_id")).alias("_n"))
    many = numbered.groupBy("_l").agg(F.max("_n").alias("_many")).agg(F.array_sort(F.collect_list(F.struct("_l", "_many"))).alias("_langs"))
    sent = base.where("lang is not null").crossJoin(F.broadcast(many))  # one row
    sent = sent.withColumn("_langs", F.filter("_langs", lambda x: x["_l"] != F.col("lang"))).where(F.size("_langs") > 0)
    sent = sent.withColumn("_at", F.get("_langs", F.pmod(F.xxhash64("generation_id", F.lit(7)), F.size("_langs")).cast("int")))
    sent = sent.withColumns({"_l": F.col("_at._l"), "_n": (F.pmod(F.xxhash64("generation_id", F.lit(11)), F.col("_at._many")) + 1).cast("int")})
    wrong = sent.join(numbered, ["_l", "_n"]).select("generation_id", F.col("_to").alias("prompt_id"), "error", F.lit("other_language").alias("planted"), "text")
    return direct.unionByName(wrong)


def with_planted(generations: DataFrame, prompts: DataFrame) -> DataFrame:
    """All responses and all that is planted into them, as :func:`prepare` reads it.

    Equal planted texts under one prompt are one row with the number of its copies. Those planted unchanged are no rows
    of their own: ``sound`` marks the responses that stand for them.
    """
    real = generations.select("generation_id", "prompt_id", "error", "text", F.lit(None).cast("string").alias("planted"), F.lit(1).cast("bigint").alias("copies"), _takes().alias("sound"))
    planted = plant(generations, prompts).where("planted <> 'none'")
    own = planted.where("planted in ('truncated', 'other_language')").withColumn("copies", F.lit(1).cast("bigint"))
    told = planted.where("planted not in ('truncated', 'other_language')").groupBy("prompt_id", "error", "planted", "text").agg(F.min("generation_id").alias("generation_id"), F.count("*").alias("copies"))
    return real.unionByName(own.unionByName(told).withColumn("sound", F.lit(False)))


def label_table(votes: DataFrame) -> DataFrame:
    """(defect, pattern, odds) of the patterns above the validated cutoff of their defect."""
    counts, _ = pattern_odds(votes)
    least = {r.defect: math.log(r.cutoff / (1 - r.cutoff)) for r in validated_cutoffs(counts).itertuples()}
    kept = {(r.defect, r.pattern): float(r.odds) for r in counts.itertuples() if r.odds > least[r.defect]}
    return votes.sparkSession.createDataFrame([(*k, o) for k, o in kept.items()], "defect string, pattern string, odds double")


def labels(votes: DataFrame) -> DataFrame:
    """(generation_id, defect, posterior, odds): every label above its cutoff; a response may have several."""
    kept = coded_votes(votes).where("planted is null").join(F.broadcast(label_table(votes)), ["defect", "pattern"])  # bounded as above
    return kept.select("generation_id", "defect", (1 / (1 + F.exp(-F.col("odds")))).alias("posterior"), "odds").distinct()


def one_defect(labelled: DataFrame) -> DataFrame:
    """The label of each response that the votes favour most."""
    rank = F.array_position(F.array(*[F.lit(d) for d in PRECEDENCE]), F.col("defect"))
    return labelled.groupBy("generation_id").agg(F.max_by("defect", F.struct(F.round("odds", 6), -rank)).alias("defect"))
