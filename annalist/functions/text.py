"""Scalar functions over texts and sessions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose full upper case is several letters but that have one, and that one: sharp s and Greek letters with a subscript.
MANY = "ß" + "".join(chr(c) for lo in (0x1F80, 0x1F90, 0x1FA0) for c in range(lo, lo + 8)) + "ᾳῃῳ"
ONE = "ẞ" + "".join(chr(c) for lo in (0x1F88, 0x1F98, 0x1FA8) for c in range(lo, lo + 8)) + "ᾼῌῼ"


def token_count(text: Column) -> Column:
    """A third of the characters, rounded down: the default stand-in for a tokenizer."""
    return F.floor(F.length(text) / 3.0)


def truncate_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, 3 * n)


def chunk_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens that overlap; the last one may be short. An empty text has none."""
    step = 3 * (size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(3 * size)))


def render_session(session_id: Column, timestamp: Column, messages: Column, domain: Column | None = None) -> Column:
    """Header lines and a line for each message; a null timestamp prints as None."""
    head = [F.concat(F.lit("SESSION "), session_id), F.concat(F.lit("TIME "), F.coalesce(timestamp.cast("string"), F.lit("None")))]
    if domain is not None:
        head.append(F.concat(F.lit("DOMAIN "), domain))
    return F.concat_ws("\n", *head, F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])))


def session_ids(text: Column) -> Column:
    """Ids in square brackets after ``session:``, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[session:([^\]\s]+)\]"), F.lit(1)))


def clean(text: Column) -> Column:
    """Punctuation to blanks, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_entity(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def parse_choice(reply: Column, valid: Column) -> Column:
    """The choice in a reply: a JSON object's choice_id, else one written as such, else a bare id; null if none is valid."""
    body = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    ways = [
        F.get_json_object(F.regexp_extract(body, r"(?s)(\{.*?\})", 1), "$.choice_id"),
        F.regexp_extract(body, r"(?i)choice_id[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9]+)", 1),
        F.regexp_extract(body, r"^\s*\(?([A-Za-z0-9]+)\)?[.:]?\s*$", 1),
    ]
    return F.coalesce(*(F.when(F.array_contains(valid, F.trim(w)), F.trim(w)) for w in ways))


def tagged(text: Column, tag: str) -> Column:
    """The content of ``<tag>`` if there is exactly one."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) == 1, found[0])


def yes_no(text: Column) -> Column:
    """The first yes or no that stands as a word, letters of any script apart; null without one."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)(?<![\p{L}\p{N}_])(yes|no)(?![\p{L}\p{N}_])", 1)), F.lit(""))


def long_enough(text: Column, least: int = 20) -> Column:
    """At least so many words where all characters are ASCII, else so many characters, without blanks at the ends; null and blank texts are not."""
    own = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.size(F.split(own, r"\s+"))
    return F.coalesce((own != "") & (F.when(own.rlike(r"^[\x00-\x7F]*$"), words).otherwise(F.length(own)) >= least), F.lit(False))


def without_markers(text: Column, markers: tuple[str, ...]) -> Column:
    """Texts that hold none of ``markers``; a null text holds none."""
    return ~F.coalesce(F.greatest(*(F.contains(text, F.lit(m)) for m in markers), F.lit(False)), F.lit(False))


def detect_script(text: Column) -> Column:
    """zh where over three tenths of the characters are CJK, else en."""
    return F.when(F.regexp_count(text, F.lit(r"[一-鿿]")) > 0.3 * F.length(text), "zh").otherwise("en")


def parse_session_time(text: Column) -> Column:
    """``YYYY/MM/DD (Sat) HH:MM[:SS]``, dates with hyphens or slashes, or ISO; null if none fits."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\([A-Za-z]{3}\)\s*", ""), "/", "-"), "T", " ")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")))


def source_id(text: Column, top: int) -> Column:
    """An integer, an integral float, or leading digits; else 0; kept within 0 and ``top``."""
    value = F.coalesce(F.try_to_number(text, F.lit("999999999")).cast("long"), F.when(text.rlike(r"^\d+\.0+$"), F.regexp_extract(text, r"^(\d+)", 1).cast("long")), F.nullif(F.regexp_extract(text, r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(top), value))


def html_text(html: Column) -> Column:
    """The readable text of a page: scripts, styles and tags go, the common entities are read, blanks are joined."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def tokenize_simple(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case words of letters and digits of three characters or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)


def json_lenient(text: Column) -> Column:
    """The object in a reply, as JSON text: fences go, a missing last brace is added; null if it still is none."""
    body = F.regexp_replace(text, "```(?:json)?", "")
    from_brace = F.when(F.locate("{", body) > 0, F.substring(body, F.locate("{", body), F.length(body)))
    whole = F.regexp_extract(from_brace, r"(?s)^(\{.*\})", 1)
    fixed = F.concat(F.rtrim(from_brace), F.lit("}"))
    return F.when(F.try_parse_json(whole).isNotNull(), whole).when(F.try_parse_json(fixed).isNotNull(), fixed)


def first_object(text: Column) -> Column:
    """The first complete flat JSON object of a reply; null without one."""
    found = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(\{[^{}]*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def parse_choice_current(reply: Column, valid: Column, strict: bool = False) -> Column:
    """The choice of the first complete object, under choice_id or decision; strict takes an object of one key only."""
    obj = first_object(reply)
    said = F.trim(F.coalesce(F.get_json_object(obj, "$.choice_id"), F.get_json_object(obj, "$.decision")))
    fits = F.array_contains(valid, said)
    return F.when(fits & (F.size(F.json_object_keys(obj)) == 1) if strict else fits, said)


def upper_letter(letter: Column) -> Column:
    """One letter in upper case as one letter, as DuckDB has it; where full mapping gives several (SS), the single one, or the letter as it is."""
    full = F.upper(letter)
    return F.when(F.length(full) <= 1, full).otherwise(F.translate(letter, MANY, ONE))


def sentences(text: Column) -> Column:
    """Parts that end behind a stop followed by white space; empty parts go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def expand_citations(text: Column, ids: Column) -> Column:
    """Bracketed short ids as full markers where exactly one id equals the short one or ends with it behind an underscore."""
    cited = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_, ]+)\]"), F.lit(1)), lambda c: F.split(c, r",\s*"))))

    def marker(c: Column) -> Column:
        fits = F.filter(ids, lambda i: (i == c) | F.endswith(i, F.concat(F.lit("_"), c)))
        return F.when(F.size(fits) == 1, F.concat(F.lit("[session:"), fits[0], F.lit("]"))).otherwise(F.concat(F.lit("["), c, F.lit("]")))

    # Lists of short ids are told apart first, then each is put in its place.
    apart = F.regexp_replace(text, r"(?<=[A-Za-z0-9_]),\s*(?=[A-Za-z0-9_]+(?:,\s*[A-Za-z0-9_]+)*\])", "] [")
    return F.aggregate(cited, apart, lambda acc, c: F.replace(acc, F.concat(F.lit("["), c, F.lit("]")), marker(c)))


def valid_summary(text: Column, headings: list[str], ids: Column) -> Column:
    """All headings as lines in their order, every cited id known, every bullet with a citation."""
    found = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.isin(*headings))
    bullets = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("- ")))
    return (found == F.array(*map(F.lit, headings))) & F.forall(session_ids(text), lambda i: F.array_contains(ids, i)) & F.forall(bullets, lambda b: F.size(session_ids(b)) > 0)


def render_bounded(facts: Column, per_section: int = 1, chars: int = 240, n_ids: int = 2) -> Column:
    """Facts (section, text, ids) as markdown: so many a section, cut texts, at most so many ids behind each."""
    line = lambda f: F.concat(F.lit("- "), F.substring(f["text"], 1, chars), F.lit(" "), F.array_join(F.transform(F.slice(f["ids"], 1, n_ids), lambda i: F.concat(F.lit("[session:"), i, F.lit("]"))), " "))
    sections = F.array_distinct(F.transform(facts, lambda f: f["section"]))
    part = lambda s: F.concat(F.lit("## "), s, F.lit("\n"), F.array_join(F.transform(F.slice(F.filter(facts, lambda f: f["section"] == s), 1, per_section), line), "\n"))
    return F.array_join(F.transform(sections, part), "\n")


def build_prompt(context: Column, query: Column, choices: Column, task: Column | None = None) -> Column:
    """The reader's prompt: memory, question, a line for each choice, and the task where one is given."""
    parts = [F.concat(F.lit("MEMORY\n"), context), F.concat(F.lit("QUESTION\n"), query), F.concat(F.lit("CHOICES\n"), F.array_join(F.transform(choices, lambda c: F.concat(c["choice_id"], F.lit(". "), c["text"])), "\n"))]
    return F.concat_ws("\n\n", *parts, *([task] if task is not None else []))


def json_keys(text: Column) -> Column:
    """Names of all keys of a JSON text, at any depth."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\\\\.", ""), F.lit(r'"([^"]*)"\s*:'), F.lit(1)))
