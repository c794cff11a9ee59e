"""Sentence units of texts in any script, with offsets.

Characters are read by their sentence-break properties (terminator, full stop, opening, closing, space, upper, lower,
number, letter without case), as in the rules of Unicode for sentence boundaries, tailored in five ways:
abbreviations of any language of the lists and initials do not end a sentence; what stands in quotation marks or brackets stays within the
sentence that holds it; headings and list items are units; scripts without spaces end at their own terminators; Thai
ends at a space that sets off no number, and Korean polite endings end a sentence that lost its full stop.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on, whatever follows.
ALWAYS = {
    "en": "Dr Prof Mr Mrs Ms Rev Capt Col Gen Lt Sgt St Hon Gov Sen Rep Messrs Mt vs cf viz e.g i.e approx esp",
    "de": "Dr Prof Hr Fr Hrn Frl Dipl Ing St vgl Vgl bzw evtl ggf inkl sog z.B d.h u.a o.ä i.d.R",
    "fr": "Dr Pr Mme Mlle MM Me Mgr St Ste cf Cf p.ex env av apr",
    "es": "Dr Dra Sr Sra Srta Sres Ud Uds Prof Profa Lic Ing Sto Sta cf p.ej aprox",
    "ru": "Проф проф Акад акад Доц им См см Ср ср г-н г-жа тов",
    "hi": "डॉ श्री श्रीमती प्रो पं",
    "ar": "د أ م ص",
}
#: Abbreviations after which a sentence goes on before a number or a letter that stands for one.
REFERENCE = {
    "en": "No Nos Fig Figs fig figs Sec Secs sec ch Ch chap Chap p pp P Pp vol Vol vols app App art Art ed Ed eq Eq no nos para Tab tab",
    "de": "Nr Nrn Abb Kap Anm S Bd Art Abs Tab Ziff Seite ca etwa Jh",
    "fr": "n no art fig Fig chap Chap vol t p pp éd env ch tabl ann",
    "es": "núm Núm núms pág Pág págs cap Cap caps fig Fig vol Vol art Art n aprox env",
    "ru": "рис Рис гл Гл с С стр табл Табл т ст п № д кв г ок",
}
MONTHS = set("Januar Jänner Februar Feber März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sep Sept Okt Nov Dez Jahrhundert Jh Kapitel Band Auflage".split())
#: Words that go on after dots of omission, or after a quotation, in scripts without case.
GO_ON = set("그러나 하지만 그런데 그래도 그리고 फिर और लेकिन पर मगर तो कि ثم و لكن ولكن ف بل".split())
GO_ON_DENSE = ("それでも", "しかし", "だが", "でも", "けれど", "但是", "但", "然而", "可是", "不过", "却")
QUOTATIVE = set("하고 하며 하면서 라고 라는 라며 라면서 이라고 이라는 이라며 고 는 은 란 이란 면서 하는 하던 했다 하자".split())

_ALWAYS = {w for v in ALWAYS.values() for w in v.split()}
_REFERENCE = {w for v in REFERENCE.values() for w in v.split()}
_MARKS_AFTER_QUOTE_JA = ("と", "って", "という", "とい", "との", "なん", "では", "は", "が", "を", "に", "の", "も")
_SPEECH_ZH = re.compile(r"[^，。！？；：\n]{0,24}?(?:一边说|说道|说着|写道|问道|喊道|叫道|答道|说|问|喊|叫)")

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_HEAD = re.compile(r"[^\S\r\n]{0,3}#{1,6}(?=\s|$)")
_ITEM = re.compile(r"[^\S\r\n]*(?:[-*+•‣◦·]|(\d{1,3})[.)](?![^\S\r\n]+\d{1,2}\.\D))[^\S\r\n]+")

_ROCK_N_ROLL = re.compile("'[nN]'")

_DOTS = ".…‥"
#: Marks that need a start of a sentence after them, as a full stop does.
_SOFT = "!?‼⁇⁈⁉‽⸮"
#: All characters with the sentence-break property of a terminator, whatever the script, and the wide and small full stops.
_FULL = "．﹒" + "".join(c for c in regex.findall(r"\p{Sentence_Break=STerm}", "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)) if c not in _SOFT)
_TERM = _DOTS + _SOFT + _FULL
_OPEN = {"(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》", "〔": "〕", "{": "}"}
_SHUT = {v: k for k, v in _OPEN.items()}
_BEFORE_TOKEN = set("([{（“”„«»‹›\"'‘「」『』（）)]，、：；,;:" + _FULL + "！？!?…")
_BRACKETS = set("([（［【〔{")
_EVENT = re.compile("[" + re.escape(_TERM) + "]+|[" + re.escape("".join(_OPEN) + "".join(_SHUT) + "“”„‟«»‹›‘’‚\"'＂") + "]|\\s+")


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """'u' upper, 'l' lower or other letter with case, 'H' Hangul, 'C' Han and kana, 'T' Thai and its like, 'A' other letters without case, '0' digit, '' else."""
    o = ord(c)
    if c.isdigit():
        return "0"
    if 0xAC00 <= o <= 0xD7AF or 0x1100 <= o <= 0x11FF or 0x3130 <= o <= 0x318F or 0xA960 <= o <= 0xA97F:
        return "H"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF or o in (0x3005, 0x3007):
        return "C"
    if 0x0E00 <= o <= 0x0EFF or 0x1780 <= o <= 0x17FF or 0x1000 <= o <= 0x109F:
        return "T"
    if c.isupper() or unicodedata.category(c) == "Lt":
        return "u"
    if c.islower():
        return "l"
    if unicodedata.category(c)[0] in "LM":
        return "M" if unicodedata.combining(c) and o < 0x590 else "A"
    return ""


def _before(text: str, i: int, least: int) -> str:
    """Script of the last letter or digit before ``i``, over closing marks; '' if twelve marks or more lie between."""
    for j in range(i - 1, max(least, i - 12) - 1, -1):
        s = _script(text[j])
        if s and s != "M":
            return s
    return ""


def _word(text: str, i: int, most: int, to: int) -> str:
    """The word that starts at ``i``, composed."""
    j = i
    while j < to and j - i < most and not text[j].isspace():
        j += 1
    return unicodedata.normalize("NFC", text[i:j])


def _token(text: str, i: int, least: int) -> str:
    """What stands before the stop at ``i`` up to a space or an opening mark, at most 24 characters: more than any abbreviation has."""
    j = i
    while j > least and i - j < 24 and not text[j - 1].isspace() and text[j - 1] not in _BEFORE_TOKEN and _script(text[j - 1]) != "C":
        j -= 1
    return unicodedata.normalize("NFC", text[j:i])


def _starts_clause(text: str, k: int) -> bool:
    """Whether the mark or letter at ``k`` can start a sentence in a script with case."""
    c = text[k]
    s = _script(c)
    if s == "M":
        return True
    if s:
        return s != "l"
    if c in _OPEN or c in "“„«‹‘\"'¿¡":
        for j in range(k + 1, min(k + 4, len(text))):
            t = _script(text[j])
            if t:
                return t != "l"
        return True
    return c not in ",;:)]}»”’،؛、，"


def _stops(text: str, i: int, j: int, k: int, a: int, b: int) -> bool:
    """Whether the terminators text[i:j], outside any quotation, end a sentence that goes on at ``k``."""
    if k >= b:
        return True
    run = text[i:j]
    spaced = k > j
    nxt = text[k]
    prev = _before(text, i, a)
    following = _script(nxt)
    if nxt in ",;:،؛、，" and not spaced:
        return False
    if any(c in _FULL for c in run) and not (set(run) <= {"．"} and not spaced):
        return True
    dots = set(run) <= set(_DOTS)
    if dots and run != ".":  # dots of omission
        if following == "l":
            return False
        word = _word(text, k, 12, b)
        if word in GO_ON or word.startswith(GO_ON_DENSE):
            return False
        if prev == "C":
            return spaced and not re.match(r"[^，。！？\n]{0,14}还是", text[k : k + 20])
        return spaced or following == "u"
    if not dots:
        if not spaced:
            return following in ("u", "H", "C", "A") and prev != "0" or nxt in "¿¡" or nxt in _OPEN or nxt in "“„«"
        return not (following == "l" and prev in ("l", "u", "0"))
    # a single full stop
    if not spaced:
        if text[i - 1 : i].isdigit() or i == a:
            return False
        if prev in ("H", "C", "A"):
            return bool(following) and following != "0" or nxt in _OPEN or nxt in "“„«‘\"'"
        if prev == "l" and following == "u":
            after = _script(text[k + 1]) if k + 1 < b else ""
            token = _token(text, i, a)
            return after in ("l", "", "M") and token.rsplit(".", 1)[-1] not in _ALWAYS and "://" not in token and not (after == "" and text[k + 1 : k + 2] in ".")
        return False
    if following == "l" and prev not in ("H", "C", "A", "T"):
        return False
    if not following and not _starts_clause(text, k):
        return False
    token = _token(text, i, a)
    last = token.rsplit(".", 1)[-1]
    if token in _ALWAYS or last in _ALWAYS and not last.isdigit():
        return False
    if len(last) == 1 and last.isalpha() and re.match(r"[^\W\d_]\.", text[k : k + 2]):
        return False  # the first of two abbreviated words
    if last and _script(last[-1]) == "u" and (len(last) == 1 or not last[-2].isalnum()):
        return False  # an initial
    if prev == "M" or not last:
        return True
    if last in _REFERENCE or token in _REFERENCE:
        word = _word(text, k, 8, b)
        if following == "0" or re.match(r"[A-ZА-Я][.\d,)]|[B-HJ-Z]$|[IVXLC]{2,}\b", word):
            return False
    if last.isdigit():
        if following == "0":
            # parts of a date or of a number
            return not (len(last) <= 4 and re.match(r"\d{1,4}[.,\s]", text[k : k + 6]) and prev == "0" and (len(last) == 4 or re.match(r"\d{1,2}\.", text[k : k + 4]) is not None))
        if len(last) <= 2 and _word(text, k, 16, b).strip(".,;:)“”") in MONTHS:
            return False
    if following == "l":
        return prev in ("H", "C", "A", "T")
    return True


def _stops_after_close(text: str, opened: int, mark: str, j: int, k: int, a: int, b: int, start: int) -> bool:
    """Whether a sentence ends after the quotation or bracket text[opened:j], which ends with a terminator."""
    if k >= b:
        return True
    alone = opened == start
    spaced = k > j
    nxt = text[k]
    following = _script(nxt)
    inner = _before(text, j - 1, a)
    bracket = mark in _BRACKETS
    if bracket and not alone:
        return False
    if nxt in ",;:،؛、，—–)]}）”»" and not spaced or nxt in ",;،؛、，":
        return False
    if not spaced:
        if nxt in _OPEN or nxt in "“„«‘":
            return alone or nxt not in _BRACKETS
        if inner == "C" or following == "C":
            if bracket:
                return True
            if following == "H":
                return False
            if text.startswith(_MARKS_AFTER_QUOTE_JA, k):
                return False
            if _SPEECH_ZH.match(text, k, min(b, k + 40)) and alone:
                return False
            return alone or text[opened - 1] in "：:"
        return bracket and following in ("u", "C")
    if following == "l":
        return False
    if inner in ("H", "A", "T", "C"):
        word = _word(text, k, 12, b)
        if word in QUOTATIVE or word in GO_ON:
            return False
        if inner == "C" and text.startswith(("と", "って", "という"), k):
            return False
        return True
    return _starts_clause(text, k)


def _last_apostrophe(text: str, a: int, b: int, ignore: set[int]) -> int:
    """The last straight apostrophe of text[a:b] that can close a quotation, -1 if there is none."""
    p = text.rfind("'", a + 1, b)
    while p > a and (p in ignore or text[p - 1].isspace() or p + 1 < b and _script(text[p + 1]) in ("l", "u")):
        p = text.rfind("'", a + 1, p)
    return p


def _paragraph(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Units of the paragraph text[a:b]; it is read again without the marks left unclosed until none is left."""
    while a < b and text[a].isspace():
        a += 1
    ignore = {p for m in _ROCK_N_ROLL.finditer(text, a, b) for p in (m.start(), m.end() - 1)}
    last = _last_apostrophe(text, a, b, ignore)
    while True:
        out, unclosed = _read(text, a, b, ignore, last)
        if not unclosed:
            yield from out
            return
        ignore |= unclosed


def _read(text: str, a: int, b: int, ignore: set[int], last: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Units of text[a:b] and the marks found unclosed; no straight apostrophe from ``last`` on opens a quotation."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    passed: list[int] = []  # apostrophes that would have opened a quotation, had the only open mark not been one
    start, i = a, a

    def end(at: int, nxt: int) -> None:
        nonlocal start
        if at > start:
            out.append((start, at))
        start = nxt

    while i < b and (m := _EVENT.search(text, i, b)):
        i, j = m.span()
        c = text[i]
        if c.isspace():
            if not stack and j < b:
                p, n = _script(text[i - 1]) if i > a else "", _script(text[j])
                if p == "T" and n == "T":
                    end(i, j)
                elif p == "H" and n in ("H", "u", "0", "l") and unicodedata.normalize("NFC", text[max(start, i - 9) : i]).endswith(("니다", "니까")):
                    end(i, j)
            i = j
            continue
        if c in _TERM:
            if not stack:
                stop = j
                k = stop
                while k < b and text[k].isspace():
                    k += 1
                if text[j : j + 1] and text[j] in _SHUT or text[j : j + 1] in ("”", "»", "’") and j < b:
                    pass
                elif _stops(text, i, j, k, a, b):
                    end(stop, k)
            i = j
            continue
        i = j
        if m.start() in ignore:
            continue
        at = m.start()
        left = text[at - 1] if at > a else " "
        right = text[j] if j < b else " "
        closes: str | None = None
        if c in _OPEN:
            stack.append((c, at))
        elif c in _SHUT:
            closes = _SHUT[c]
        elif c in "„‚‟":
            stack.append((c, at))
        elif c in "“‘":
            if stack and stack[-1][0] == ("„" if c == "“" else "‚"):
                closes = stack[-1][0]
            else:
                stack.append((c, at))
        elif c in "”’":
            pairs = "“„‟”" if c == "”" else "‘‚"
            if stack and stack[-1][0] in pairs:
                if not (c == "’" and _script(left) and _script(right) in ("l", "u")):
                    closes = stack[-1][0]
        elif c in "«»‹›":
            other = {"«": "»", "»": "«", "‹": "›", "›": "‹"}[c]
            if stack and stack[-1][0] == other:
                closes = other
            elif c in "«‹" or left.isspace():
                stack.append((c, at))
        elif c in "\"＂":
            if stack and stack[-1][0] == c:
                closes = c
            else:
                stack.append((c, at))
        else:  # a straight apostrophe
            if stack and stack[-1][0] == "'":
                if not left.isspace() and _script(right) not in ("l", "u"):
                    closes = "'"
                elif len(stack) == 1 and (left.isspace() or left in _OPEN) and not right.isspace():
                    passed.append(at)
            elif at < last and (left.isspace() or left in _OPEN or at == a) and not right.isspace():
                stack.append((c, at))
        if closes is None or not any(s == closes for s, _ in stack):
            continue
        while stack[-1][0] != closes:
            stack.pop()
        mark, opened = stack.pop()
        if stack:
            continue
        p = at - 1
        while p > opened and (text[p].isspace() or text[p] in "”»’)」』）“"):
            p -= 1
        if p <= opened or text[p] not in _TERM:
            continue
        if j < b and text[j] in _TERM:
            continue
        k = j
        while k < b and text[k].isspace():
            k += 1
        if _stops_after_close(text, opened, mark, j, k, a, b, start):
            end(j, k)
            i = max(i, k if k > j else j)
    end(b, b)
    unclosed = {at for _, at in stack}
    if len(stack) == 1 and stack[0][0] == "'":  # those passed over since it opened would find the same and stay open too
        unclosed.update(at for at in passed if at > stack[0][1])
    return out, unclosed


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """Offsets (code points, end exclusive) of the sentence units of a text, without white space around them."""
    if not text:
        return []
    lines: list[tuple[int, int]] = []
    at = 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    units: list[tuple[int, int]] = []
    region: list | None = None  # start, end, is an item

    def close() -> None:
        nonlocal region
        if region is not None:
            s, e, whole = region
            units.extend([(s, e)] if whole else _paragraph(text, s, e))
            region = None

    number: int | None = None
    for s, e in lines:
        if not text[s:e].strip():
            close()
            number = None
            continue
        if h := _HEAD.match(text, s, e):
            close()
            units.append((h.end(), e))
            number = None
            continue
        m = _ITEM.match(text, s, e)
        if m and m.end() < e:
            n = int(m.group(1)) if m.group(1) else None
            if region is None or region[2] and (n is None or number is not None and n == number + 1):
                close()
                region = [m.end(), e, True]
                number = n
                continue
        if region is None:
            region = [s, e, False]
        else:
            region[1] = e
    close()
    trimmed = []
    for s, e in units:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            trimmed.append((s, e))
    return trimmed


def sentence_table(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """One row for each sentence unit: key, unit INT from 1, start_pos, end_pos INT, with ``with_text`` also its text.

    Null, empty and blank texts give no row; a row given twice gives its units twice.
    """
    kind = df.schema[key].dataType.simpleString()
    more = ", sentence string" if with_text else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, nums, starts, ends, texts = [], [], [], [], []
            for k, t in zip(b["k"], b["t"], strict=True):
                for n, (s, e) in enumerate(sentence_units(t), 1):
                    keys.append(k)
                    nums.append(n)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        texts.append(t[s:e])
            if not keys:
                continue
            out = {"k": keys, "unit": nums, "start_pos": starts, "end_pos": ends}
            yield pd.DataFrame(out | ({"sentence": texts} if with_text else {}))

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return rows.mapInPandas(run, f"k {kind}, unit int, start_pos int, end_pos int{more}").withColumnRenamed("k", key)
