"""Text decoded with a wrong encoding: find it, and restore it by round trips.

A candidate is a pair: the encoding the text was read in, and the one it was written in. A text's runs that the first
can write are turned into bytes again; the parts of them that the second decodes strictly replace the characters they
came from, if a garbling cost of the part, with its neighbours, drops. That is repeated for nested layers. What no
candidate restores but holds replacement characters or control codes, which stand in no sound text, is reported as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text is changed if its cost drops by at least this much.
LEAST_DROP = 0.9
#: A text of which no word costs this much holds no text of an encoding of one or two bytes read in another.
LEAST_WORD = 0.7
#: A restored text is given if its cost for each character beyond ASCII is at most this.
MOST_LEFT = 0.6

#: Encodings that UTF-8 is read in by mistake.
UTF8_READ_AS = ("cp1252", "latin-1", "cp949", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "iso8859-15", "cp932", "gbk", "big5", "koi8-r", "cp866")
#: (written in, read in) for encodings of one or two bytes.
LEGACY = (("cp949", "cp1252"), ("cp949", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp932", "cp1252"), ("cp932", "latin-1"), ("gb18030", "cp1252"), ("gb18030", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("gb18030", "cp949"), ("cp949", "gbk"), ("cp932", "cp949"), ("cp949", "cp932"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp850", "cp1252"))

_CYRILLIC = {"cp1251", "koi8-r", "cp866"}
_WIDE = {"cp949", "cp932", "gbk", "gb18030", "big5", "euc_jp"}

_HIGH = re.compile("[^\x00-\x7f]+")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_WHOLE_UTF8 = re.compile(rb"(?<![\x80-\xff])" + _UTF8.pattern + rb"(?![\x80-\xff])")
_SPACE = re.compile("[ \t-\r]+")
_C1 = {chr(c) for c in range(0x80, 0xA0)}
_SURE = re.compile("[�\x80-\x84\x86-\x9f]")
#: Signs of Latin-1 and of the usual 8-bit code pages that stand alone in sound text.
_SIGNS = set("¡¢£¤¥¦§¨©ª¬®¯°±²³´µ¶¸¹º¼½¾¿×÷‚ƒ„†‡ˆ‰‹•˜™›€¤∞∂∑∏∫√≈≠≤≥◊Ω⌐¬")


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """Rough class of a character for the cost."""
    o = ord(c)
    if o < 0x80:
        return "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "."
    if o == 0xFFFD or 0x80 <= o <= 0x9F and o != 0x85 or 0xE000 <= o <= 0xF8FF:
        return "!"
    if o in (0xA0, 0xAD, 0x85):
        return "_"
    if c in _SIGNS:
        return "s"
    if 0xAC00 <= o <= 0xD7A3:
        return "h" if len(c.encode("cp949")) == 2 and all(b >= 0xA1 for b in c.encode("cp949")) else "H"
    if 0x3040 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF:
        return "k"
    if 0xFF61 <= o <= 0xFF9F:
        return "K"
    if 0xF900 <= o <= 0xFAFF:
        return "C"
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
        return "c"
    if 0x2500 <= o <= 0x259F:
        return "b"
    if 0x2460 <= o <= 0x24FF or 0x3200 <= o <= 0x33FF:
        return "n"
    if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
        return "y"
    if 0x400 <= o <= 0x52F:
        return "Y"
    if 0x3131 <= o <= 0x318F or 0x1100 <= o <= 0x11FF:
        return "j"
    category = unicodedata.category(c)
    if category == "Cn":
        return "!"
    if 0xC0 <= o <= 0x17F or 0x1E00 <= o <= 0x1EFF or o in (0x192, 0x218, 0x219, 0x21A, 0x21B, 0x1A0, 0x1A1, 0x1AF, 0x1B0):
        return "L" if c.isupper() else "l"
    if category[0] == "M":
        return "m"
    if category[0] == "P" or category in ("Zs", "Cf"):
        return "p"
    if category[0] == "L":
        return "g"
    return "o"


#: Characters beyond ASCII, and ASCII letters after one.
_NEAR = re.compile("[^\x00-\x7f]|(?<=[^\x00-\x7f])[A-Za-z]")
_DENSE = set("hHkcCjK")
_LETTERS = set("alLgyY")
#: Letters of further scripts in wide use: Greek, Armenian, Hebrew, Arabic, Devanagari to Malayalam, Thai, Georgian.
_KNOWN = {chr(c) for a, b in ((0x370, 0x400), (0x531, 0x588), (0x5D0, 0x5F0), (0x620, 0x6D4), (0x904, 0xD80), (0xE01, 0xE5C), (0x10D0, 0x1100)) for c in range(a, b)}
#: The letters that make up most of Russian text; in text shifted to other letters they are few.
_COMMON_CYRILLIC = set("оеаинтсрвлкмдпуОЕАИНТСРВЛКМДПУ")


def cost(s: str, left: str = " ", right: str = " ") -> float:
    """How garbled ``s`` looks between its neighbours; about 0.1 a character for sound text.

    Only characters beyond ASCII, and letters next to them, cost anything; all others are passed over.
    """
    whole = left + s + right
    last, total = len(whole) - 1, 0.0
    for m in _NEAR.finditer(whole, 1, last):
        i = m.start()
        k, p, n = _kind(whole[i]), _kind(whole[i - 1]), _kind(whole[i + 1])
        if k in "a0 .":
            total += 0.3 if k == "a" and (p in _DENSE or p in "yY") else 0.0
        elif k == "!":
            total += 4
        elif k == "s":
            total += 1 if p in "lLs_g" or n in "lLsa_g" or p == "b" or n == "b" else 0.4
        elif k == "_":
            total += 1 if p in "Ls" else 0.3
        elif k in "lL":
            total += 0.25
            if p in "lL" and n in "lL":
                total += 0.5
            if p == "0" or n == "0":
                total += 1
            if p in "yY" or n in "yY":
                total += 0.8
            if k == "l" and n == "a" and whole[i + 1].isupper():
                total += 0.8
            if k == "L" and p in "la":
                total += 1
            if p in "sb_!" or n in "sb_!":
                total += 0.5
        elif k == "b":
            total += 1.2 if p in "lLsga_yY" or n in "lLsga_yY" else 0.3
        elif k == "y":
            total += 0.1 if whole[i] in _COMMON_CYRILLIC else 0.35
            if p in "alLg" or n in "alLg":
                total += 0.7
        elif k in "hk":
            total += 0.1
            if p in _LETTERS or n in _LETTERS:
                total += 0.2
        elif k == "H":
            total += 0.9
        elif k == "c":
            total += 0.15
            if p in "hH" or n in "hH":
                total += 0.8
            if p in _LETTERS or n in _LETTERS:
                total += 1.2
        elif k == "C":
            total += 2
        elif k == "K":
            total += 0.7
        elif k == "Y":
            total += 0.9
        elif k == "n":
            total += 0.9 if p in "hHcC" or n in "hHcC" else 0.3
        elif k == "p":
            inside = p in "alL" and n in "alL" and whole[i] not in "’‘·‐‑"
            total += 0.9 if inside or p in "lLs!" and n in "lLsa!" else 0.1
        elif k == "g":
            total += (0.2 if whole[i] in _KNOWN else 1.5) + (1.2 if p in "lLasbyY" or n in "lLasbyY" else 0)
        elif k == "o":
            total += 0.4 + (1.5 if p in "lLayYhcg" or n in "lLayYhcg" else 0)
        else:
            total += 0.3
        if k == "y" and p == "y":
            a, b = whole[i - 1], whole[i]
            if a.islower() and b.isupper():
                total += 1
    return total


#: The cost of words and sentences, which come again.
_known_cost = lru_cache(maxsize=100_000)(cost)


def _writer(encoding: str) -> tuple[dict[str, bytes], int]:
    """Byte of each character of a one-byte encoding; bytes it leaves undefined stand for control codes."""
    table = {}
    for b in range(256):
        raw = bytes([b])
        try:
            c = raw.decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, raw)
    return table, 1


@lru_cache(maxsize=None)
def _one_byte(encoding: str) -> dict[str, bytes] | None:
    return None if encoding in ("cp949", "cp932", "gbk", "gb18030", "big5", "euc_jp") else _writer(encoding)[0]


@lru_cache(maxsize=200_000)
def _write(c: str, encoding: str) -> bytes | None:
    """Bytes of one character, or None if the encoding lacks it."""
    table = _one_byte(encoding)
    if table is not None:
        return table.get(c)
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=None)
def _run_of(encoding: str) -> tuple[re.Pattern, dict[int, int]]:
    """Of a one-byte encoding: runs of characters it has, and the byte of each."""
    table = _one_byte(encoding)
    return re.compile("[" + re.escape("".join(sorted(table))) + "]+"), {ord(c): raw[0] for c, raw in table.items()}


def _bytes_of(run: str, encoding: str) -> bytes:
    """A run that a one-byte encoding can write, as bytes."""
    return run.translate(_run_of(encoding)[1]).encode("latin-1")


def _segments(text: str, encoding: str) -> Iterator[tuple[int, int, bytes, Sequence[int]]]:
    """Maximal runs the encoding can write, unless plain ASCII: start, end, bytes, and the character of each byte."""
    if encoding not in _WIDE:
        for m in _run_of(encoding)[0].finditer(text):
            raw = _bytes_of(m.group(), encoding)
            if not raw.isascii():
                yield m.start(), m.end(), raw, range(m.start(), m.end())
        return
    n, i = len(text), 0
    while i < n:
        raw, where, high, start = bytearray(), [], False, i
        while i < n and (b := _write(text[i], encoding)) is not None:
            raw += b
            where += [i] * len(b)
            high = high or len(b) > 1 or b[0] > 0x7F
            i += 1
        if high:
            yield start, i, bytes(raw), where
        i += 1 if i == start or i < n else 0


def _try_utf8(text: str, encoding: str) -> tuple[str, float] | None:
    """The text with all parts that decode as UTF-8 and cost less then, and the drop of the cost."""
    edits: list[tuple[int, int, str, float]] = []
    whole = encoding in _CYRILLIC or encoding in _WIDE  # their letters are sound text too: no part of a word will do
    for _, _, raw, where in _segments(text, encoding):
        for m in _UTF8.finditer(raw):
            a, b = where[m.start()], where[m.end() - 1] + 1
            if whole and (a and text[a - 1] > "\x7f" or b < len(text) and text[b] > "\x7f"):
                continue
            if m.end() < len(where) and where[m.end()] == b - 1 or m.start() and where[m.start() - 1] == a:
                continue  # half of a two-byte character
            new = m.group().decode("utf-8")
            left, right = text[a - 1 : a] or " ", text[b : b + 1] or " "
            drop = cost(text[a:b], left, right) - cost(new, left, right)
            if drop > 0:
                edits.append((a, b, new, drop))
    total = sum(e[3] for e in edits)
    if not edits or total < LEAST_DROP:
        return None
    if whole:
        near = len(_HIGH.findall(text, edits[0][0], edits[-1][1]))
        if sum(len(e[2]) for e in edits) < 3 or 2 * len(edits) < near:
            return None
    out, at = [], 0
    for a, b, new, _ in edits:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], total




def _try_legacy(text: str, written: str, read: str) -> tuple[str, float] | None:
    """The text with the segments whose every high run decodes strictly as ``written`` at a clearly lower cost."""
    least = 6 if written in _CYRILLIC else 4 if written in _WIDE else 1
    out, at, total = [], 0, 0.0
    for a, b, raw, _ in _segments(text, read):
        for s in re.finditer(r"[^.!?\n]+[.!?\n]*\s*", text[a:b]) if b - a > 1 else ():
            old = s.group()
            if sum(map(len, _HIGH.findall(old))) < least:
                continue
            try:
                new = (b"".join(_write(c, read) for c in old) if read in _WIDE else raw[s.start() : s.end()]).decode(written)
            except UnicodeDecodeError:
                continue
            before, after = _known_cost(old), cost(new)
            if before - after >= 0.3 and after < (0.8 if read in _CYRILLIC and written in _CYRILLIC else 0.5) * before:
                out += [text[at : a + s.start()], new]
                at, total = a + s.end(), total + before - after
    return ("".join(out) + text[at:], total) if total >= LEAST_DROP else None


def suspicious(text: str) -> bool:
    """Whether some word costs as much as garbled ones do; only such texts are taken apart for other encodings than UTF-8.

    Words end at ASCII white space only: U+00A0 and U+0085 may be the second half of a garbled character.
    """
    return any(_known_cost(w) >= LEAST_WORD for w in _SPACE.split(text) if not w.isascii())


def _may_be_utf8(text: str, encoding: str) -> bool:
    """Whether the bytes of the text hold anything like UTF-8 at all; for sound scripts, a whole run of them."""
    if encoding in _WIDE or encoding in _CYRILLIC:
        return _WHOLE_UTF8.search(text.encode(encoding, "replace")) is not None
    return _UTF8.search(text.encode(encoding, "ignore")) is not None or not _C1.isdisjoint(text)


def _fits(read: str, kinds: set[str]) -> bool:
    """Whether text of these kinds may have been read in this encoding."""
    if read in _CYRILLIC:
        return bool(kinds & set("yY"))
    if read in _WIDE:
        return bool(kinds & set("hHcCkKn"))
    return bool(kinds & set("lLs_!bgpo"))


def _whole(text: str) -> Iterator[tuple[float, int, str]]:
    """The text with one whole layer off: all of it can be written in a reader's encoding, and the bytes are UTF-8 to the last."""
    limit = cost(text) - LEAST_DROP
    for i, read in enumerate(UTF8_READ_AS):
        if read not in _WIDE and _run_of(read)[0].fullmatch(text):
            try:
                new = _bytes_of(text, read).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if (left := cost(new)) <= limit:
                yield left, i, new


def _inwards(text: str, reads: tuple[str, ...]) -> tuple[str, int]:
    """Takes off layers until none lowers the cost enough: of the reader of the outermost layer in parts, of any reader as a whole."""
    layers = 0
    while not text.isascii():
        more = [(cost(g[0]), i, g[0]) for i, r in enumerate(reads) if (g := _try_utf8(text, r))] or list(_whole(text))
        if not more:
            break
        text, layers = min(more)[2], layers + 1
    return text, layers


def repair(text: str | None) -> tuple[str, int]:
    """The restored text and the number of layers taken off; (text, 0) if none is garbled so that it can be restored.

    Every candidate for the outermost layer is followed inwards. As each layer lowers the cost by at least :data:`LEAST_DROP`, this
    ends. Of all ends the one with the least cost is taken.
    """
    if not text or text.isascii():
        return text or "", 0
    kinds = {_kind(c) for c in set(text)}
    ends = []
    for i, read in enumerate(UTF8_READ_AS):
        if _fits(read, kinds) and _may_be_utf8(text, read) and (got := _try_utf8(text, read)):
            reads = ("cp1252", "latin-1") if read in ("cp1252", "latin-1") else () if read in _WIDE else (read,)
            new, layers = _inwards(got[0], reads)
            if "cp1252" in reads:
                new = new.replace("Ã  ", "à ")  # its second byte, a no-break space, was made a plain one
            ends.append((cost(new), i, new, layers + 1))
    for i, (written, read) in enumerate(LEGACY if suspicious(text) else (), len(UTF8_READ_AS)):
        if _fits(read, kinds) and (got := _try_legacy(text, written, read)):
            new, layers = _inwards(got[0], ())
            ends.append((cost(new), i, new, layers + 1))
    if not ends or (best := min(ends))[0] >= cost(text) - LEAST_DROP:
        return text, 0
    return best[2], best[3]


def sounds(text: str) -> bool:
    """Whether a restored text is worth to be given: its cost a character beyond ASCII is near that of sound text."""
    return cost(text) <= MOST_LEFT * sum(c > "\x7f" for c in text)


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose text is garbled: key, restored STRING, layers INT (passes made), whole BOOLEAN.

    ``restored`` is null where nothing could be restored; ``whole`` says that no sign of garbling is left.
    Null, empty and plain ASCII texts are never garbled. Equal texts of a batch are looked at once.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, tuple[str, int]] = {}
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                if t not in seen:
                    seen[t] = repair(t)
                new, layers = seen[t]
                if layers or _SURE.search(t):
                    sound = layers > 0 and sounds(new)
                    rows.append((k, new if sound else None, layers if sound else 0, sound and not _SURE.search(new)))
            yield pd.DataFrame(rows, columns=["k", "restored", "layers", "whole"])

    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7F]"))
    return texts.mapInPandas(run, f"k {kind}, restored string, layers int, whole boolean").withColumnRenamed("k", key)
