"""Line-level text predicates and rewrites as Column expressions.

Nulls stay null unless said otherwise; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closing marks that may follow a sentence's end, sentence ends, and what a continued line starts with.
CLOSERS = r"[\s\"')\]»”’]*"
TERMINALS = ".!?…:"
CONTINUERS = r"[),;»”’]"
NBSP = " "


def is_terminated(text: Column) -> Column:
    """Ends a sentence, closing marks aside; an empty text does."""
    bare = F.regexp_replace(text, CLOSERS + "$", "")
    return (bare == "") | F.substring(bare, -1, 1).isin(*TERMINALS)


def ends_hyphen(text: Column) -> Column:
    """Ends with a hyphen that splits a word."""
    return F.rlike(text, F.lit(r"\p{L}[-¬]\s*$"))


def looks_continuation(text: Column) -> Column:
    """First character in lower case, or a mark that doesn't start a sentence."""
    return F.rlike(text, F.lit(rf"^\s*(\p{{Ll}}|{CONTINUERS})"))


def looks_bold(text: Column) -> Column:
    """A short line in capitals: at most 60 characters, two words and two capitals or more, no small letter."""
    bare = F.trim(text)
    return (
        (F.length(bare) <= 60)
        & ~F.rlike(bare, F.lit(r"\p{Ll}"))
        & (F.regexp_count(bare, F.lit(r"\S+")) >= 2)
        & (F.regexp_count(bare, F.lit(r"\p{Lu}")) >= 2)
    )


def looks_heading(text: Column) -> Column:
    """At most 60 characters and 8 words, no sentence end, over 70 % of the letters capitals."""
    bare = F.trim(text)
    letters = F.regexp_count(bare, F.lit(r"\p{L}"))
    return (
        (F.length(bare) <= 60)
        & (F.regexp_count(bare, F.lit(r"\S+")) <= 8)
        & ~F.rlike(bare, F.lit(r"[.!?…:;,]$"))
        & (letters > 0)
        & (F.regexp_count(bare, F.lit(r"\p{Lu}")) * 10 > letters * 7)
    )


def join_lines(before: Column, after: Column) -> Column:
    """Two lines of a paragraph: a split word is glued, other lines get a space between."""
    left, right = F.rtrim(before), F.ltrim(after)
    glued = F.concat(F.regexp_replace(left, "[-¬]$", ""), right)
    spaced = F.concat_ws(" ", F.when(left != "", left), F.when(right != "", right))
    return F.when(ends_hyphen(left) & F.rlike(right, F.lit(r"^\p{Ll}")), glued).otherwise(spaced)


def join_all(lines: Column) -> Column:
    """``join_lines`` over an array, in order."""
    return F.aggregate(lines, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(join_lines(a, x)))


def norm_running(text: Column) -> Column:
    """Signature of a running head: small letters without digits and punctuation, white space joined."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", ""), r"[^\p{L}\s]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def is_page_number(text: Column) -> Column:
    """At most 12 characters, only digits, letters of roman numbers and light marks, one of them no mark."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.rlike(bare, F.lit(r"^[\p{Nd} IVXLCDMivxlcdm.—\-–()\[\]]{1,12}$")) & F.rlike(bare, F.lit(r"[\p{L}\p{Nd}]"))


def list_marker(text: Column) -> Column:
    """The text after a bullet or a number, or null; dashes are dialogue, not bullets."""
    found = F.regexp_extract(text, r"^\s*(?:[•·▪◦*]|\d{1,3}[.)]|[A-Za-z]\)|[IVXLC]{1,6}\.)\s+(.*)$", 1)
    return F.when(found != "", found)


def strip_html(html: Column) -> Column:
    """Tags become spaces, white space is joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Without [tag] marks."""
    return F.regexp_replace(text, r"\[/?[a-z][a-z0-9_ #]*\]", "")


def html_to_text(html: Column) -> Column:
    """Block ends become line ends; scripts and comments go; entities of the common marks are read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|ul|ol)>", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", ""), "&nbsp;", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    bare = F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_markdown(html: Column) -> Column:
    """Headings, list items, emphasis and links in Markdown, the rest as ``html_to_text``."""
    out = html
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>\s*(.*?)\s*</li>", "- $1\n")
    out = F.regexp_replace(out, r"(?is)<(b|strong)>(.*?)</\1>", r"**$2**")
    out = F.regexp_replace(out, r"(?is)<(i|em)>(.*?)</\1>", r"*$2*")
    out = F.regexp_replace(out, r"(?is)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", r"[$2]($1)")
    return html_to_text(out)


#: Superscript digits and letters, and what they stand for.
SUPERSCRIPTS, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉ", "0123456789abcde"


def norm_superscripts(text: Column) -> Column:
    """Runs of Unicode superscripts as ``$^{n}$``."""
    marked = F.regexp_replace(text, f"([{SUPERSCRIPTS}]+)", r"\$^{$1}\$")
    return F.translate(marked, SUPERSCRIPTS, PLAIN)


def superscript_refs(text: Column) -> Column:
    """Distinct references ``$^{n}$`` in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(norm_superscripts(text), F.lit(r"\$\^\{([0-9a-z]{1,3})\}\$"), F.lit(1)))


def note_entries(text: Column) -> Column:
    """Distinct note numbers that start a line, parenthesised or superscript, in order."""
    plain = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\(([0-9]{1,3})\)\s"), F.lit(1))
    raised = F.regexp_extract_all(norm_superscripts(text), F.lit(r"(?m)^\s*\$\^\{([0-9a-z]{1,3})\}\$"), F.lit(1))
    return F.array_distinct(F.concat(plain, raised))


def split_definitions(text: Column) -> tuple[Column, Column]:
    """Lines that define notes, and the other lines."""
    lines = F.split(text, "\n")
    is_note = lambda x: F.rlike(x, F.lit(r"^\[\^[^\]]+\]:"))
    return F.array_join(F.filter(lines, is_note), "\n"), F.array_join(F.filter(lines, lambda x: ~is_note(x)), "\n")


def page_text(markdown: Column, header: Column, footer: Column) -> Column:
    return F.concat_ws("\n", markdown, header, footer)


def fmt_list(values: Column, most: int = 6, sep: str = ",") -> Column:
    """The first values joined, and how many more there are."""
    size = F.size(values)
    head = F.array_join(F.slice(values, 1, most), sep)
    return F.when(size > most, F.concat(head, F.lit(sep + "+"), (size - most).cast("string"), F.lit(" more"))).otherwise(head)


def fixed(x: Column, digits: int) -> Column:
    """A number with 1 to 6 decimals, rounded by its exact binary value as C and Python do; format_string rounds its shortest decimal.

    The number is split in two, so that its distance from the middle between two results is exact. From 2^52 units of the
    last decimal on, format_string writes it.
    """
    x, scale = x.cast("double"), 10**digits
    size = F.abs(x)
    low, high = F.floor(size * float(scale)), size.cast("float").cast("double")
    over = (high * float(scale) - (low + 0.5)) + (size - high) * float(scale)
    n = low + F.when(over + low % 2 * 1e-30 > 0, 1).otherwise(0)  # from the middle to the even one
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    return F.when(size < 2.0**52 / scale, text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def fmt_ms(ms: Column) -> Column:
    """43ms, 1.28s, 2.1m."""
    return (
        F.when(ms < 1000, F.format_string("%dms", F.bround(ms).cast("long")))
        .when(ms < 60_000, F.concat(fixed(ms / 1000, 2), F.lit("s")))
        .otherwise(F.concat(fixed(ms / 60_000, 1), F.lit("m")))
    )


def fmt_percentiles(stops: list[Column], unit: str = "") -> Column:
    """Five stops of a distribution as text."""
    return F.concat(F.concat_ws("/", *(F.coalesce(fixed(s, 1), F.lit("null")) for s in stops)), F.lit(unit))


def fmt_counts(counts: Column) -> Column:
    """A map of counts, the largest first and names in order."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["k"], F.lit("="), (-e["n"]).cast("string"))), " ")


def slug_of_file(path: Column) -> Column:
    """File name without folders and known endings."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.regexp_replace(name, r"(?i)\.(db|sqlite|project|pdf|zip|json)$", "")


def split_block_text(text: Column, lines: Column) -> Column:
    """A block's text dealt to its lines; where the numbers differ, all on the first."""
    parts = F.split(text, "\n")
    joined = F.concat(F.array(F.regexp_replace(text, r"\s*\n\s*", " ")), F.array_repeat(F.lit(""), lines - 1))
    return F.when(lines <= 0, F.array().cast("array<string>")).when(F.size(parts) == lines, parts).otherwise(joined)


def table_markdown(cells: Column) -> Column:
    """Sparse cells array<struct<row,col,text>> as a Markdown table; the first row is the header."""
    rows, cols = F.array_max(F.transform(cells, lambda c: c["row"])), F.array_max(F.transform(cells, lambda c: c["col"]))
    clean = lambda t: F.replace(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit(r"\|"))

    def cell(r: Column, c: Column) -> Column:
        own = F.filter(cells, lambda x: (x["row"] == r) & (x["col"] == c))
        return F.when(F.size(own) > 0, clean(F.element_at(own, 1)["text"])).otherwise(F.lit(""))

    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), cols), lambda c: cell(r, c)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), cols + 1))
    body = F.when(rows > 0, F.concat(F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), rows), line), "\n"))).otherwise(F.lit(""))
    return F.when(F.size(cells) > 0, F.concat(line(F.lit(0)), F.lit("\n"), rule, body))


def inline_marks(text: Column, marks: Column) -> Column:
    """Comments put in at offsets, array<struct<at,mark>>, from the right; double spaces are joined."""
    order = F.reverse(F.array_sort(marks))
    put = F.aggregate(
        order, text, lambda t, m: F.concat(F.substr(t, F.lit(1), m["at"]), F.lit(" "), m["mark"], F.lit(" "), F.substr(t, m["at"] + 1))
    )
    return F.regexp_replace(put, " {2,}", " ")


#: Writing systems by language code; the common ones.
SCRIPTS = {
    "en": ["Latin"], "fr": ["Latin"], "de": ["Latin"], "es": ["Latin"], "it": ["Latin"], "la": ["Latin"],
    "el": ["Greek"], "grc": ["Greek"], "ru": ["Cyrillic"], "uk": ["Cyrillic"], "he": ["Hebrew"], "ar": ["Arabic"],
    "zh": ["Han"], "ja": ["Han", "Hiragana", "Katakana"], "ko": ["Hangul", "Han"],
}
ALL_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Han", "Hiragana", "Katakana", "Hangul")


def expected_scripts(languages: list[str]) -> list[str]:
    """Of all given languages together; nothing for unknown ones or auto."""
    return sorted({s for code in languages for s in SCRIPTS.get(code.lower().split("-")[0], [])})


def has_unexpected_script(text: Column, languages: list[str], least: int = 2) -> Column:
    """Letters of writing systems that no given language uses; a stray one doesn't count."""
    expected = expected_scripts(languages)
    if not expected:
        return F.lit(False)
    others = "".join(rf"\p{{Is{s}}}" for s in ALL_SCRIPTS if s not in expected)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{others}]")) >= least


#: Language names by code.
LANGUAGE_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "la": "Latin", "el": "Greek", "grc": "Ancient Greek", "ru": "Russian", "zh": "Chinese", "ja": "Japanese"}


def language_hint(codes: Column) -> Column:
    """Distinct display names joined; unknown codes by themselves."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.array_join(F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.try_element_at(names, c), c))), ", ")


def time_ago(at: Column, now: Column) -> Column:
    """Age in words: under 45 s just now; minutes, hours, days, months of 30 and years of 365 days."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at))

    def said(n: Column, unit: str) -> Column:
        n = F.floor(n)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(seconds < 45, "just now")
        .when(seconds < 3600, said(F.greatest(F.lit(1), seconds / 60), "minute"))
        .when(seconds < 86_400, said(seconds / 3600, "hour"))
        .when(seconds < 30 * 86_400, said(seconds / 86_400, "day"))
        .when(seconds < 365 * 86_400, said(seconds / (30 * 86_400), "month"))
        .otherwise(said(seconds / (365 * 86_400), "year"))
    )


def is_lone_token(text: Column) -> Column:
    """A line that isn't worth a second reading: blank, digits but for . and , or one token without a space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (bare == "") | F.rlike(F.regexp_replace(bare, "[.,]", ""), F.lit(r"^\p{Nd}+$")) | ~bare.contains(" ")
