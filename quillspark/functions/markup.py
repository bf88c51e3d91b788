"""Formulas, fonts, JSON and numbers in words. Column expressions, with Arrow functions where a match needs its own rule."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# fixed values: number words
ONES = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN".split()
TENS = "ZERO TEN TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()
# fixed values: words of prose that a formula does not hold, how often a sign may occur before a formula counts as a
# runaway of its reader, environments, and functions that a formula names
PROSE = (
    "removal addition reaction substance element because identify undergoing problem solution calculate compound determine consider "
    "following example exercise between according definition simultaneous apparent observed therefore oxidised reduced"
).split()
RUNAWAY = {r"\tilde": 4, r"\mp": 4, r"\lambda": 5, "~": 6, r"\Gamma": 5, r"\Psi": 5, r"\Omega": 3, r"\mathfrak": 4}
ENVIRONMENTS = "array matrix pmatrix bmatrix vmatrix cases align aligned".split()
FUNCTIONS = "sin cos tan cot sec cosec log ln exp lim sqrt".split()


def number_words(n: Column) -> Column:
    """Whole numbers under 1000 in words; others as digits."""
    word = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    low = lambda k: F.when(k < 20, word(ONES, k % 20)).otherwise(F.concat(word(TENS, F.floor(k / 10) % 10), F.when(k % 10 > 0, F.concat(F.lit(" "), word(ONES, k % 10))).otherwise("")))
    size = F.abs(n)
    hundreds = F.concat(word(ONES, F.floor(size / 100) % 10), F.lit(" HUNDRED"), F.when(size % 100 > 0, F.concat(F.lit(" AND "), low(size % 100))).otherwise(""))
    text = F.when(size < 100, low(size % 100)).when(size < 1000, hundreds).otherwise(size.cast("string"))
    return F.when(n < 0, F.concat(F.lit("MINUS "), text)).otherwise(text)


def marks_words(marks: Column) -> Column:
    """4.0 as FOUR, 8.5 as EIGHT POINT FIVE; null as ZERO."""
    value = F.round(F.coalesce(marks.cast("double"), F.lit(0.0)), 2)
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    tenths = F.bround((value - whole) * 10).cast("int")
    return F.when(tenths > 0, F.concat(number_words(whole), F.lit(" POINT "), F.element_at(F.array(*map(F.lit, ONES)), tenths + 1))).otherwise(number_words(whole))


#: A formula's commands, escaped signs, braces and other characters.
_TOKEN = re.compile(r"\\(?P<command>[a-zA-Z]+)|\\(?P<escaped>.)|(?P<brace>[{}])|(?P<other>.)", re.S)
# fixed values: characters that have a command, or another character, in a formula
WRITTEN = {"→": "\\rightarrow ", "⇌": "\\rightleftharpoons ", "–": "-", "—": "-", "\\&": "&"}


class _Mender:
    """A formula as its reader left it, token by token, and what mends it."""

    def __init__(self, text: str):
        body = text.strip()
        for fence in ("$$", "$"):
            if body.startswith(fence) and body.endswith(fence) and len(body) > 2 * len(fence):
                body = body[len(fence) : -len(fence)].strip()
        self.tokens = [m[0] for m in _TOKEN.finditer(body)]

    def text(self) -> str:
        return "".join(self.tokens)

    def _back(self, k: int, *of: str) -> int:
        """The place before k behind which only tokens of these stand."""
        while k and (self.tokens[k - 1] in of or (" " in of and self.tokens[k - 1].isspace())):
            k -= 1
        return k

    def without_label(self) -> _Mender:
        """Without the number of the equation: digits in a parenthesis at the end, behind a wide space, white space, or
        with a sized closing sign that nothing opens."""
        end = self._back(len(self.tokens), " ")
        inner = self._back(end, ")", "\\right", "}", " ")
        closing = self.tokens[inner:end]
        digits = self._back(inner, *"0123456789.")
        start = self._back(digits, " ")
        if digits == inner or not start or self.tokens[start - 1] != "(":
            return self
        gap = self._back(start - 1, " ")
        if gap and self.tokens[gap - 1] in ("\\quad", "\\qquad"):
            self.tokens = self.tokens[: gap - 1]
            return self.without_label()
        elif "}" in closing and "\\right" in closing[closing.index("}") :]:  # the wide space was read as letters of an upright word
            word = self._back(gap, *"quad", " ")
            if word > 1 and self.tokens[word - 2 : word] == ["\\mathrm", "{"] and "".join(self.tokens[word:gap]).endswith("quad"):
                self.tokens = self.tokens[: word - 2]
        elif ")" in closing and "}" not in closing and (gap < start - 1 or "\\right" in closing):
            self.tokens = self.tokens[: gap if gap < start - 1 else start - 1]
        return self

    def with_written_signs(self) -> _Mender:
        """Characters by their commands; a bar before a parenthesis, an operator or a command was a closing bracket."""
        for k, t in enumerate(self.tokens):
            following = next((x for x in self.tokens[k + 1 :] if not x.isspace()), "")
            self.tokens[k] = "]" if t == "|" and following[:1] in tuple("(+-=→\\") else WRITTEN.get(t, t)
        return self

    def without_runaway(self) -> _Mender:
        """Cut before a fraction of a command by itself, with the index that holds it."""
        for k, t in enumerate(self.tokens):
            parts = self.tokens[k + 1 : k + 7]
            if t in ("\\frac", "\\cfrac") and len(parts) == 6 and parts[::3] == ["{", "{"] and parts[2::3] == ["}", "}"] and parts[1] == parts[4] and parts[1][1:].isalpha():
                k -= bool(k and self.tokens[k - 1] == "{")
                k -= bool(k and self.tokens[k - 1] in "_^")
                self.tokens = self.tokens[:k]
                break
        return self

    def with_paired_sides(self) -> _Mender:
        """Brackets are plain; a sized sign that a plain parenthesis opens is plain too; an invisible one at the end, or
        behind an array, goes. Where left and right ones are not as many, all are plain."""
        out: list[str] = []
        opened: list[int] = []  # places of plain parentheses since the last command
        tokens = iter([*self.tokens, ""])
        for t in tokens:
            if t in ("\\left", "\\right"):
                sign = next(tokens)
                plain = sign == ("[" if t == "\\left" else "]") or (t == "\\right" and sign == ")" and opened)
                hidden = t == "\\right" and sign == "." and "".join(out).rstrip().endswith("\\end{array}")
                out += [] if hidden else [sign] if plain else [t, sign]
                if plain and sign == ")":
                    opened.pop()
                elif not plain:
                    opened.clear()
                continue
            if t == "(":
                opened = [len(out)]
            elif t == ")" or t.startswith("\\"):
                opened.clear()
            out.append(t)
        self.tokens = [t for t in out if t]
        end = self._back(len(self.tokens), " ")
        if self.tokens[max(end - 2, 0) : end] == ["\\right", "."]:
            self.tokens = self.tokens[: end - 2]
        if self.tokens.count("\\left") != self.tokens.count("\\right"):
            around = {"\\left": "([{|", "\\right": ")]}|."}
            self.tokens = [t for t, sign in zip(self.tokens, [*self.tokens[1:], " "], strict=True) if not (t in around and sign in around[t])]
        return self

    def with_whole_environments(self) -> _Mender:
        """Arrays of one column get two where cells are separated; ends of environments that never begin go."""
        text = self.text()
        if "&" in self.tokens:
            text = text.replace("\\begin{array}{c}", "\\begin{array}{ll}")
        for name in ENVIRONMENTS:
            if f"\\begin{{{name}}}" not in text:
                text = text.replace(f"\\end{{{name}}}", "")
        self.tokens = [m[0] for m in _TOKEN.finditer(text)]
        return self

    def with_even_braces(self) -> _Mender:
        """Missing closing braces added, or surplus ones taken from the end."""
        lack = sum(t.count("{") - t.count("}") for t in self.tokens)
        while lack < 0 and self.tokens and self.tokens[-1] == "}":
            self.tokens.pop()
            lack += 1
        self.tokens += ["}"] * max(lack, 0)
        return self


def mended(text: str | None) -> str:
    """A formula without wrappers, equation numbers and reader faults, its delimiters and braces balanced; null is empty."""
    formula = _Mender(text or "")
    return formula.without_label().with_written_signs().without_runaway().with_paired_sides().with_whole_environments().with_even_braces().text().strip()


@F.pandas_udf(StringType())
def clean_formula(text: pd.Series) -> pd.Series:
    return text.map(mended)


class _Signs:
    """What the tokens of a formula add up to: one walk over commands, braces, words and other characters."""

    NAME, TWICE = re.compile(r"\{([a-zA-Z*]+)\}"), re.compile(r"\{(\\[a-zA-Z]+)\}\{\1\}")

    def __init__(self, formula: str):
        self.open_braces = self.sides = 0
        self.ends: Counter = Counter()
        fractions = 0
        for m in _TOKEN.finditer(formula):
            command = m["command"]
            if m["brace"]:
                self.open_braces += 1 if m[0] == "{" else -1
            elif command in ("left", "right"):
                self.sides += 1 if command == "left" else -1
            elif command in ("begin", "end"):
                name = self.NAME.match(formula, m.end())
                if name:
                    self.ends[name[1]] += 1 if command == "end" else -1
            elif command in ("frac", "cfrac"):
                fractions += bool(self.TWICE.match(formula, m.end()))
        words = [w.lower() for w in re.findall(r"\b[a-zA-Z]{3,}\b", formula)]
        prose = sum(w in PROSE for w in words)
        self.sentence = prose >= (2 if len(words) > 12 else 3)
        self.runaway = fractions >= 2 or any(formula.count(sign) > most for sign, most in RUNAWAY.items()) or bool(re.search(r"\{{5}|\}{5}|(?:\\_\s*){4}", formula))

    def sound(self) -> bool:
        return not (self.sentence or self.runaway or self.open_braces or self.sides or any(n > 0 for n in self.ends.values()))


@F.pandas_udf(BooleanType())
def is_formula(text: pd.Series) -> pd.Series:
    """Whether a string is a sound formula: no prose, balanced braces, sides and environments, no runaway repeats."""
    return text.map(lambda t: bool(t and t.strip()) and _Signs(t.strip()).sound())


# fixed values: letters three places on, and the signs that the last ones become
_SHIFT = {c: chr((c - base - 3) % 26 + base) for base in (65, 97) for c in range(base, base + 26)} | {91: "X", 92: "Y", 93: "Z"}


def unshift_word(word: str) -> str:
    """A word moved back by three letters; a kept capital and all-capital words end up in their usual case."""
    if len(word) > 1 and word[0].islower() and word[1].isupper():
        return word[0].upper() + word[1:].translate(_SHIFT).lower()
    plain = word.translate(_SHIFT)
    return plain.lower() if len(word) > 1 and word.isupper() else plain


@F.pandas_udf(StringType())
def unshift(text: pd.Series) -> pd.Series:
    word = re.compile(r"[A-Za-z\\\[\]]+")
    return text.map(lambda t: t if t is None else word.sub(lambda m: unshift_word(m[0]), t))


def _sign(name: str) -> str:
    return unicodedata.lookup(f"DEVANAGARI {name}")


#: Vowel signs of which one holds the other, and the sign that may stand apart from its double.
_HELD = {_sign("VOWEL SIGN E"): _sign("VOWEL SIGN O") + _sign("VOWEL SIGN AU"), _sign("VOWEL SIGN AI"): _sign("VOWEL SIGN O") + _sign("VOWEL SIGN AU")}
_VISARGA = _sign("SIGN VISARGA")


def undoubled(text: str) -> str:
    """NFC text in which Devanagari vowel signs and marks are not doubled, in one walk: a mark that repeats the one before
    it, or that it holds, is left out, and so is a visarga that follows another, whatever the space between."""
    out, last = [], ""
    for c in unicodedata.normalize("NFC", text):
        before, last = last, c
        if "\u0900" <= c <= "\u097f" and unicodedata.category(c) in ("Mn", "Mc"):
            if c == before or before and before in _HELD.get(c, ""):
                continue
            if (before, c) == tuple(_HELD) and out[-1:] == [before]:  # e before ai
                out.pop()
            elif c == _VISARGA and "".join(out).rstrip().endswith(c):
                del out[len("".join(out).rstrip()) :]
                continue
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


@F.pandas_udf(StringType())
def single_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else undoubled(t))


_LEXER = re.compile(rf"(?P<marked>\$[^$]+\$)|(?P<name>\b[a-zA-Z](?:\s*\d+)?\b)|(?P<call>\b(?:{'|'.join(FUNCTIONS)})\b)|(?P<number>\b\d+(?:\.\d+)?\b)|(?P<sign>[-+*/^=()\[\],])|(?P<space>\s+)|(?P<other>\w+|.)", re.S)


def _expressions(tokens: list[tuple[str, str]]):
    """Ranges of tokens to mark: an equation of a name, a sum of two names in parentheses, or a name with an index."""
    solid = [i for i, (kind, _) in enumerate(tokens) if kind != "space"]
    k = 0
    while k < len(solid):
        here = [tokens[i] for i in solid[k : k + 5]]
        kinds, last = [kind for kind, _ in here], None
        if kinds[0] == "name" and here[1:2] == [("sign", "=")]:
            last = k + 1
            while last + 1 < len(solid) and tokens[solid[last + 1]][0] in ("name", "call", "number", "sign"):
                last += 1
            last = last if last > k + 1 else None
        if last is None and kinds == ["sign", "name", "sign", "name", "sign"] and here[0][1] == "(" and here[2][1] in "-+*/" and here[4][1] == ")":
            last = k + 4
        if last is None and kinds[0] == "name" and len(here[0][1]) > 1:
            last = k
        if last is not None:
            yield solid[k], solid[last] + 1
            k = last
        k += 1


def mark_math(text: str) -> str:
    """Equations, sums in parentheses and indexed names of a text as $...$; formulas that are marked already stay."""
    tokens = [(m.lastgroup, m[0]) for m in _LEXER.finditer(text)]
    out, done = [], 0
    for a, b in _expressions(tokens):
        out += [t for _, t in tokens[done:a]]
        said = ""
        for kind, t in tokens[a:b]:
            if kind == "name" and len(t) > 1:
                t = f"{t[0]}_{{{t[1:].strip()}}}"
            elif kind == "space":
                t = " "
            said += f" {t} " if kind == "sign" and t in "-+*/=" else t
        said = re.sub(r"(?<=\() | (?=\))", "", " ".join(said.split()))
        out.append(f"${said}$")
        done = b
    return "".join(out) + "".join(t for _, t in tokens[done:])


@F.pandas_udf(StringType())
def inline_math(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else mark_math(t))


def repair_json_text(raw: str | None) -> str | None:
    """JSON out of a model's answer: fences dropped, stray backslashes doubled, a cut list closed after its last whole item."""
    if raw is None:
        return None
    body = re.sub(r"^\s*```(?:json)?|```\s*$", "", raw.strip()).strip()
    start = min((i for i in (body.find("["), body.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    for text in (body, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", body)):
        try:
            return json.dumps(json.JSONDecoder(strict=False).raw_decode(text)[0])
        except ValueError:
            pass
    ends = [m.end() for m in re.finditer(r"\}", text)]
    for end in reversed(ends):
        for tail in ("]", "]}", ""):
            try:
                return json.dumps(json.loads(text[:end] + tail, strict=False))
            except ValueError:
                continue
    return None


@F.pandas_udf(StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repair_json_text)


def drafts(answer: Column) -> Column:
    """Question drafts of an answer (a list, or an object with `questions`) with a text of five characters or more."""
    item = "struct<question_text: string, question_type: string, marks: double, difficulty: string, options: map<string,string>, correct_answer: string>"
    fixed = repair_json(answer)
    listed = F.coalesce(F.from_json(F.when(fixed.startswith("["), fixed), f"array<{item}>"), F.from_json(F.when(fixed.startswith("{"), fixed), f"struct<questions: array<{item}>>")["questions"])
    return F.filter(listed, lambda q: F.length(F.trim(q["question_text"])) >= 5)
