"""Text functions as column expressions: normalising, cleaning, script and garbage measures. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------------

#: Question words and function words that say nothing about a question's subject.
STOP_WORDS = (
    "what is the a an of in to for with on at by from up about into over after which who whom whose where when how why "
    "define state explain describe calculate find determine evaluate mention write give list name following given does "
    "do did can could would and having net or their its are be"
).split()
#: Suffixes in the order in which they are tried.
SUFFIXES = "ations ation tions tion ical ment ing ies ed es ic ly s".split()
#: Names of symbol glyphs that leak out of typesetting fonts.
GLYPHS = (
    "trianglert triangleleft triangleup triangledown trianglesmall squarebullet roundbullet diamondbullet squarebox checkbox "
    "arrowright arrowleft arrowup arrowdown bulletcircle bulletdisc hyphenbullet"
).split()
#: Units, titles, abbreviations and numerals that may stand alone on a line.
SHORT_LABELS = (
    "rs in cm mm m km g kg s ms hr min hz khz mhz v a w kw no no. dr dr. mr mr. ms. mrs mrs. prof vs vs. ex ex. fig fig. sec sec. "
    "art art. ch ch. vol vol. pp pp. pg pg. etc etc. al al. i ii iii iv vi vii viii ix x xi xii i. ii. iii. iv. v. vi. vii. viii. ix. x. "
    "सं. क्र. पृ. रु. कि. मी. डॉ. श्री श्रीमती"
).split()
#: Words as they look after a shift of three letters.
SHIFTED_WORDS = "wkh tkh dqg ri iurp wklv tklv zlwk zklfk wr lq lv duh xqlw kdvehhq".split()
#: Short words that get glued to the word before them.
GLUED_SUFFIXES = "has is was are were had have that with from for and the not this been".split()
#: Words that end like glued ones but are whole.
NOT_GLUED = (
    "withhas whereas thomas canvas bias basis crisis analysis emphasis oasis paralysis thesis antithesis hypothesis synthesis "
    "genesis nemesis parenthesis debris axis praxis metropolis towards forward afterwards outwards inwards upwards downwards"
).split()
SINGLE_LATIN, SINGLE_DEVANAGARI, SINGLE_GUJARATI = "aiAI", "व०१२३४५६७८९", "આએઓઈઉ૦૧૨૩૪૫૬૭૮૯"

_LATIN_INDIC = r"A-Za-z\x{0900}-\x{097f}\x{0a80}-\x{0aff}"


def let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


# --- normalising ----------------------------------------------------------------------------------------------------


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_question(text: Column) -> Column:
    """Lower case without LaTeX spacing and punctuation (formula signs stay); null gives an empty text."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\\[,;! ]", "")
    return collapse(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s$\\^{}]", " "))


def stem(word: Column) -> Column:
    """The word without the first listed suffix that leaves more than three letters."""
    out = F.lower(word)
    chain = None
    for s in SUFFIXES:
        fits = F.endswith(out, F.lit(s)) & (F.length(out) > len(s) + 3)
        cut = F.substring(out, F.lit(1), F.length(out) - len(s))
        chain = F.when(fits, cut) if chain is None else chain.when(fits, cut)
    return chain.otherwise(out)


def stems(text: Column, stop_words: bool = True) -> Column:
    """Stemmed words of a normalised text, by default without stop words and single characters."""
    words = F.filter(F.split(normalize_question(text), " "), lambda w: F.length(w) > 0)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    return F.transform(words, stem)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of an array, joined by one space; none for fewer than n tokens."""
    last = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


# --- cleaning -------------------------------------------------------------------------------------------------------


def is_shifted(text: Column) -> Column:
    """Whether a text of 25 characters or more holds two or more words of a font shifted by three letters."""
    part = r"[A-Za-z\\\[\]]"
    return (F.length(text) >= 25) & (F.regexp_count(text, F.lit(rf"(?<!{part})(?i:{'|'.join(SHIFTED_WORDS)})(?!{part})")) >= 2)


# fixed values: a capital that stands apart from its word
_DROP_CAP, _DROP_CAP_AI = r"\b([B-HJ-Z])\s+([a-z]{2,})\b", r"\b([AI])\s+(ll|nd|n|f|t|s|nto|ts)\b"


def merge_drop_caps(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _DROP_CAP, "$1$2"), _DROP_CAP_AI, "$1$2")


def count_drop_caps(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_DROP_CAP)) + F.regexp_count(F.regexp_replace(text, _DROP_CAP, "$1$2"), F.lit(_DROP_CAP_AI))


# fixed values: a word parted by a hyphen at a line end
_HYPHEN = rf"(?<![{_LATIN_INDIC}])([{_LATIN_INDIC}]+)[-\xad]\s*\n\s*([{_LATIN_INDIC}]+)"


def rejoin_hyphens(text: Column) -> Column:
    """Words parted by a hyphen at a line end become whole; hyphens inside a line stay."""
    return F.regexp_replace(text, _HYPHEN, "$1$2")


def strip_glyphs(text: Column) -> Column:
    """Without leaked glyph names (alone or before a word) and private use symbols."""
    names = "|".join(GLYPHS)
    bare = F.regexp_replace(text, rf"(?i)\b(?:{names})([{_LATIN_INDIC}0-9]+)\b", "$1")
    return F.regexp_replace(F.regexp_replace(bare, rf"(?i)\b(?:{names})\b\s*", ""), r"[\x{f000}-\x{f8ff}]", "")


def drop_short_lines(text: Column, least: int = 4) -> Column:
    """Without lines of one token shorter than `least`, unless it is a number, list mark, known label or formula."""
    only = lambda t, chars: (t != "") & (F.translate(t, chars, "") == "")
    digits, letters = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def kind(t: Column) -> Column:
        first, last, inner, head = F.substring(t, 1, 1), F.substring(t, -1, 1), F.substring(t, F.lit(2), F.length(t) - 2), F.substring(t, F.lit(1), F.length(t) - 1)
        number = only(t, digits + ".,-")
        bracketed = ((first == "(") & (last == ")") & only(inner, digits + letters)) | ((first == "[") & (last == "]") & only(inner, digits))
        closed = last.isin(".", ")") & (only(head, digits) | ((F.length(head) == 1) & only(head, letters)))
        return F.when(number, "number").when(bracketed | closed, "mark").when(F.lower(t).isin(SHORT_LABELS), "label").when(t.contains("$"), "formula")

    def keep(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+|\s+$", "")
        return (bare == "") | bare.rlike(r"\s") | (F.length(bare) >= least) | kind(bare).isNotNull()

    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def glued_words(text: Column) -> Column:
    """Words of eight letters or more that look like two words in one, each once, in order."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-Za-z]{8,})(?![\p{L}\p{N}_])"), F.lit(1))

    def glued(w: Column) -> Column:
        low = F.lower(w)
        found = F.lit(False)
        for s in GLUED_SUFFIXES:
            head = F.length(low) - len(s)
            found = found | (F.endswith(low, F.lit(s)) & (head >= 4) & ~F.substring(low, head, F.lit(1)).isin("e", "i", "u"))
        return found & ~low.isin(NOT_GLUED)

    return F.array_distinct(F.filter(words, glued))


def garbage(text: Column, formulas_exempt: bool = True) -> Column:
    """(total, garbage, rate): weighted signs of broken text. `formulas_exempt` leaves $...$ out of the script test."""
    text = F.coalesce(text, F.lit(""))
    signs = 3 * F.regexp_count(text, F.lit("�")) + 5 * F.regexp_count(text, F.lit(r"cid:\d+")) + 2 * F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"))

    def of(token: Column) -> Column:
        n = F.length(token)
        single = (
            F.when(token.rlike("^[A-Za-z]$"), ~token.rlike(f"^[{SINGLE_LATIN}]$"))
            .when(token.rlike(r"^[\x{0900}-\x{097f}]$"), ~token.rlike(f"^[{SINGLE_DEVANAGARI}]$"))
            .when(token.rlike(r"^[\x{0a80}-\x{0aff}]$"), ~token.rlike(f"^[{SINGLE_GUJARATI}]$"))
            .otherwise(False)
        )
        size = F.when(n > 55, F.floor(n / 2)).otherwise(F.when(single, 1).otherwise(0))
        inside = F.when(token.rlike(r"[\p{L}\p{N}]"), 2 * F.regexp_count(token, F.lit(r"[|&\[\]{}*^~\\`$@=<>_]"))).otherwise(0)
        bare = F.regexp_replace(token, r"\$[^$]+\$", "") if formulas_exempt else token
        scripts = [bare.rlike(p).cast("int") for p in ("[A-Za-z]", r"[\x{0900}-\x{097f}]", r"[\x{0a80}-\x{0aff}]")]
        mixed = F.when(scripts[0] + scripts[1] + scripts[2] >= 2, F.length(bare)).otherwise(0)
        return (size + inside + mixed).cast("long")

    # most tokens show no sign of any kind, so only those that may are taken apart; scripts only mix in texts with two
    suspect = F.regexp_extract_all(text, F.lit(r"(\S{56,}|(?<!\S)\S(?!\S)|\S*[|&\[\]{}*^~\\`$@=<>_]\S*)"), F.lit(1))
    mixing = text.rlike(r"[\x{0900}-\x{097f}\x{0a80}-\x{0aff}]")
    tokens = F.when(mixing, F.filter(F.split(text, r"\s+"), lambda t: F.length(t) > 0)).otherwise(suspect)
    found = signs.cast("long") + F.aggregate(F.transform(tokens, of), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.struct(F.length(text).alias("total"), found.alias("garbage"), F.least(F.lit(1.0), found / F.greatest(F.length(text), F.lit(1))).alias("rate"))


def scripts(text: Column) -> Column:
    """Shares of Latin, Devanagari, Gujarati and other characters, without white space and digits; all 0 for none."""
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, r"[\s\p{Nd}]+", "")
    # runs are taken out whole (what counts matches lists all characters), and each text is gone through once for each
    # script, since the values are bound before they are named again
    without = lambda t, p: F.length(F.regexp_replace(t, p, ""))
    left = {"latin": r"[A-Za-z\x{c0}-\x{ff}]+", "devanagari": r"[\x{0900}-\x{097f}]+", "gujarati": r"[\x{0a80}-\x{0aff}]+"}
    counts = let(bare, lambda t: F.struct(F.length(t).alias("n"), *((F.length(t) - without(t, p)).alias(name) for name, p in left.items())))

    def shares(c: Column) -> Column:
        share = lambda x: F.when(c["n"] > 0, F.round(x / c["n"], 3)).otherwise(0.0)
        return F.struct(*(share(c[name]).alias(name) for name in left), share(c["n"] - c["latin"] - c["devanagari"] - c["gujarati"]).alias("other"))

    return let(counts, shares)


def dominant_script(mix: Column) -> Column:
    return F.when(mix["devanagari"] >= 0.35, "devanagari").when(mix["gujarati"] >= 0.35, "gujarati").when(mix["latin"] >= 0.40, "latin").when(mix["latin"] + mix["devanagari"] + mix["gujarati"] > 0, "mixed").otherwise("none")


def clean_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with `text` cleaned, `flags` of what was mended, `glued` words that are left, and `quality`.

    In this order: a shifted font read back, drop caps, hyphens at line ends, leaked glyph names, short lines, formulas
    marked, doubled Devanagari marks; glued words are named, and cost quality beside the signs of broken text. A null or
    empty text has no flags and a quality of 1.
    """
    from quillspark.functions.markup import inline_math, single_marks, unshift

    steps = [
        ("caesar_font_unshifted", lambda t: F.coalesce(unshift(F.when(is_shifted(t), t)), t)), ("drop_caps_merged", merge_drop_caps), ("hyphens_rejoined", rejoin_hyphens), ("symbols_stripped", strip_glyphs),
        ("fragments_dropped", drop_short_lines), ("math_normalized", inline_math), ("matras_deduplicated", lambda t: F.coalesce(single_marks(F.when(t.rlike(r"[\x{0900}-\x{097f}]"), t)), t)),
    ]
    rows, names = pages.withColumn("_0", F.coalesce(text, F.lit(""))), []
    for k, (name, step) in enumerate(steps):
        rows = rows.withColumn(f"_{k + 1}", step(F.col(f"_{k}")))
        names.append(F.when(F.col(f"_{k + 1}") != F.col(f"_{k}"), name))
    last = F.col(f"_{len(steps)}")
    rows = rows.withColumn("glued", glued_words(last))
    names.append(F.when(F.size("glued") > 0, "has_glued_words"))
    quality = F.greatest(F.lit(0.0), 1 - 2.5 * garbage(last)["rate"]) - F.least(F.lit(0.2), 0.05 * F.size("glued"))
    rows = rows.withColumn("quality", F.round(F.greatest(F.lit(0.0), quality), 3)).withColumn("flags", F.filter(F.array(*names), lambda x: x.isNotNull()))
    return rows.withColumn(text, last).drop(*(f"_{k}" for k in range(len(steps) + 1)))


def tokens_estimate(text: Column) -> Column:
    """Four characters of prose or two special characters to a token, one at least; none for no text."""
    text = F.coalesce(text, F.lit(""))
    special = F.regexp_count(text, F.lit(r"[$\\{}_^&=+\-*/<>\[\]]"))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((F.length(text) - special) / 4 + special / 2))).cast("long")


def heading(text: Column) -> Column:
    return F.regexp_extract(text, r"(?im)^(?:#{1,4}\s+|[A-Z0-9.\s]{2,}:|\b(?:Chapter|Section|Activity|Example|Definition|Theorem|Summary|Exercise)\b[^\n]*)", 0)


def pdf_safe(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


# fixed values: parts of the names of 8-bit Hindi fonts, and words that such a font's text shows as ASCII
LEGACY_FONTS = "chanakya kruti devlys walkman bhartiya shivaji shree bilingual akruti kundli aps- aps_ apsdv dv- dv_".split()
LEGACY_WORDS = "izse osq fkka gsa muhksaus if=kdk bznxkg x|&[kam f=k vksj gksrk rkfd".split()


def is_legacy_font(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.rlike("|".join(LEGACY_FONTS)) | (low.contains("aps") & ~low.rlike("[cmg]aps"))


def is_legacy_text(text: Column) -> Column:
    """Whether text of more than 40 characters without Devanagari holds two signs of an 8-bit Hindi font or more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.array(*map(F.lit, LEGACY_WORDS)), lambda w: F.concat(F.lit(" "), F.regexp_replace(low, r"\s+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), w, F.lit(" ")))))
    return ~low.rlike(r"[\x{0900}-\x{097f}]") & (F.length(low) > 40) & ((words >= 2) | (F.regexp_count(low, F.lit(r"\|&\[|f=k|x\|")) >= 2))
