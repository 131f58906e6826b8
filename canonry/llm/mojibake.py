"""Text that was decoded with the wrong character encoding, and its original (problem 10)."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multi-byte encodings as which UTF-8 may have been read, by Python's names.
MULTI = ("gbk", "cp949", "cp932", "big5", "euc_jp")
#: Single-byte encodings that a text may have been written in and read as; every pair of them is tried.
TRUE, READ = ("cp1258", "cp1252", "cp1251", "koi8_r", "cp850", "cp437", "mac_roman", "cp866", "iso8859_5"), ("cp1252", "cp1251", "koi8_r", "cp850", "cp437", "mac_roman", "cp1258")
#: Single-byte encodings as which UTF-8 may have been read, by Python's names.
WRONG = ("latin_1", "cp1252", "cp1251", "cp437", "mac_roman", "cp850", "cp1250", "cp1258", "koi8_r", "cp866")

# The bytes of two Vietnamese encodings, as Windows-1252 shows them.
#: TCVN 5712 (ABC fonts), lower case then the letters that have an upper case of their own.
TCVN = dict(zip(
    "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉË®ÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô\xadõøö÷ùúýûüþ" + "¡¢§£¤¥¦",
    "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ" + "ĂÂĐÊÔƠƯ",
    strict=True,
))
#: VNI for Windows: single letters, and marks that follow a letter.
VNI_SINGLE = dict(zip("ñÑôÔöÖíÍìÌæÆóÓòÒîÎ", "đĐơƠưƯíÍìÌỉỈĩĨịỊỵỴ", strict=True))
VNI_MARK = {
    "ù": "́", "ø": "̀", "û": "̉", "õ": "̃", "ï": "̣",
    "â": "̂", "á": "̂́", "à": "̂̀", "å": "̂̉", "ã": "̂̃", "ä": "̣̂",
    "ê": "̆", "é": "̆́", "è": "̆̀", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆",
}

_TONES = "̣̀́̃̉"
_ONSET = "(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|[bcdđghklmnprstvx])?"
_RIME = (
    "(?:(?:iê|yê|ươ|uô|uyê|oă|oa|oe|uâ|uê|uy|oo|a|ă|â|e|ê|i|o|ô|ơ|u|ư|y)(?:ch|ng|nh|c|m|n|p|t)"
    "|iêu|yêu|oai|oay|oeo|uây|uôi|uya|uyu|ươi|ươu|uêu|ai|ao|au|ay|âu|ây|eo|êu|ia|iu|oa|oe|oi|ôi|ơi|ua|uê|ui|uơ|uy|ưa|ưi|ưu|ya|a|e|ê|i|o|ô|ơ|u|ư|y)"
)
_SYLLABLE = re.compile(_ONSET + _RIME)
_VIETNAMESE = frozenset("ăâđêôơư")
#: The commonest letters of Russian.
_COMMON = frozenset("оеаинтсрвлкм")
_FRENCH = frozenset("àâçéèêëîïôùûüÿœæ")
_EDGE = "".join(map(chr, range(33, 127))).translate({ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}) + "“”‘’«»…–—•·‚„‹›§©®™°¿¡"
#: A micro sign or superscript belongs to a unit or number.
_UNIT = re.compile(r"^[±≈~]?[\d.,]*(?:µ|μ)(?:m|g|l|L|s|A|V|F|W|mol)[²³]?$|^[\d.,]*[A-Za-zđĐ]{0,4}[²³¹]$|^(?:n|N)?[ºª]\d*$|^\d+[ºª°]?[A-Z]?$")
#: Characters outside of which a text is looked at closer.
_PLAIN = "\\x00-\\x7f" + "".join(sorted({c for base in "aăâeêioôơuưy" for tone in ("", *_TONES) for form in (base, base.upper()) for c in unicodedata.normalize("NFC", form + tone) if ord(c) > 127})) + "đĐ“”‘’–—…•°̛̣̀́̂̃̆̉"
#: Regular expression that every text with a possible case matches: a character out of the plain ones, or plain ones in an order that words don't have.
SUSPECT = f"[^{_PLAIN}]|[ÃÂáâ][“”‘’–—…•°]|[a-z][ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝ]|a[âáàùúãõ]|e[âáàùúãõ]|o[âùúãõ]|[âêô][òìÌÒÞ]"
#: Sequences that a wrong decoding leaves and writing doesn't. A quote mark or dash that ends a word after Â or Ã may be just that.
_CAPITAL = "A-Z" + "".join(sorted({c for c in (chr(i) for i in range(0xC0, 0x1EFA)) if c.isupper() and (c < "ſ" or c in "ƠƯ" or c >= "Ẁ")}))
_CLUE = re.compile(
    "á[º»][^\\s.,;:)?!]|[ÃÂ][“”‘’–—…•](?=\\w)|[ÃÂ][‚„«°§©®¡-º¼-¿]|(?<!«)[ÃÂ]»|[ÄÅÆĂ][\xa0“”‘’‚„–—…•»«°§©®¡-¿]|â€|[Г├√Ă]\xa0"
    # Â or Ã before a no-break space inside words in capitals is a letter
    f"|[ÂÃ]\xa0(?![{_CAPITAL}])|(?<![{_CAPITAL}])[ÂÃ]\xa0"
)
#: Signs whose misread forms are known as such even where they stand alone.
_SIGNS = "’‘“”–—…•«»§°½¼¾£€©®™±µ·×"


def _sloppy(text: str, encoding: str) -> str:
    """UTF-8 bytes of a text read as `encoding`; bytes without a character become C1 controls."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode("utf-8"))


@lru_cache(maxsize=1)
def _misread() -> tuple[frozenset[str], re.Pattern[str], frozenset[str]]:
    """Second characters of misread signs, a pattern of those that aren't all letters, and those that are."""
    once = {_sloppy(c, e) for e in WRONG for c in _SIGNS}
    forms = once | {_sloppy(_sloppy(c, e), e) for e in WRONG for c in _SIGNS}
    mixed = sorted((f for f in forms if not f.isalpha()), key=len, reverse=True)
    return frozenset(f[1] for f in forms), re.compile("|".join(map(re.escape, mixed))), frozenset(f for f in forms if f.isalpha())


def _is_syllable(word: str) -> bool:
    """Whether a lower-case NFC word is built as a Vietnamese syllable."""
    apart = unicodedata.normalize("NFD", word)
    tones = [c for c in apart if c in _TONES]
    if len(tones) > 1:
        return False
    base = unicodedata.normalize("NFC", "".join(c for c in apart if c not in _TONES))
    return bool(_SYLLABLE.fullmatch(base))


@lru_cache(maxsize=1 << 17)
def cost(token: str) -> float:
    """How implausible the characters of a blank-free token are; 0 for words and numbers as they are written."""
    if token.isascii():
        return 0.0
    core = unicodedata.normalize("NFC", token)
    second, mixed, lettered = _misread()
    signs = 0.0
    if any(c in second for c in core):
        signs = sum(1.0 + 0.5 * len(f) for f in mixed.findall(re.sub("«[ÂÃ]»", "", core))) + (1.0 + 0.5 * len(core) if core in lettered else 0.0)
    total = signs + 3.0 * sum(c == "\ufffd" or "\x80" <= c <= "\x9f" or c == "\xad" for c in core) + 2.0 * len(_CLUE.findall(core))
    # an accent without a letter
    total += 2.0 * len(_STRAY.findall(core))
    return total + sum(_piece_cost(p) for p in re.split("[\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", core) if not p.isascii())


_STRAY = re.compile("(?:^|[^\\w\u0300-\u036f])[\u0300-\u036f]")
#: Letters and marks that hardly any text in Latin letters has.
_RARE = re.compile("[\u0180-\u019f\u01a2-\u01ae\u01b1-\u024f\u0250-\u02ff\u0305-\u0308\u030a-\u031a\u031c-\u0322\u0324-\u036f]")


def _piece_cost(core: str) -> float:
    trimmed = core.strip(_EDGE)
    lead = len(core) - len(core.lstrip(_EDGE))
    tail = core[lead + len(trimmed) :]
    # a symbol that clings to a letter
    total = 0.0
    if trimmed and lead and trimmed[0].isalpha() and core[lead - 1] in "§©®™°¡¿·‚„›":
        total += 1.5
    if trimmed and tail and trimmed[-1].isalpha() and tail[0] in "§©®™¡¿‚„‹·°":
        total += 1.5
    if not trimmed:
        return 2.0 * max(0, len({c for c in core if c in "§©®™¡¿‚„‹›·"}) - 1)
    if _UNIT.match(trimmed):
        return total
    return total + sum(_part_cost(p) for p in re.split(r"[-/.,;:()'’_|+&=]+", trimmed))


def _part_cost(part: str) -> float:
    if not part or part.isascii():
        return 0.0
    letters = [c for c in part if c.isalpha()]
    if not letters:
        return 0.2 * sum(not c.isascii() and unicodedata.category(c)[0] in "NP" for c in part)
    scripts = {"LATIN" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else unicodedata.name(c, "?").split()[0] for c in letters}
    symbols = 0
    for i, c in enumerate(part):
        if c.isascii() or c.isalpha() or unicodedata.category(c)[0] == "M" or c in "\u200b\u200d":
            continue
        inside = 0 < i < len(part) - 1
        symbols += inside if unicodedata.category(c)[0] == "N" else (i > 0 and part[i - 1].isalpha()) or (i + 1 < len(part) and part[i + 1].isalpha())
    lower = part.lower()
    shape = "".join("U" if c.isupper() else "l" for c in letters)
    uneven = 0.0 if shape in ("U" * len(shape), "l" * len(shape), "U" + "l" * (len(shape) - 1)) else 1.0 + 0.5 * shape.count("lU")
    if not symbols and scripts != {"LATIN"} and len(scripts) == 1:
        # capitals after small letters are a sign in scripts that have both; between readings in Cyrillic the letters that are rare in it decide
        rare = 0.02 * sum(c not in _COMMON for c in lower) if scripts == {"CYRILLIC"} else 0.0
        return rare + (uneven if "lU" in shape and lower != part and part != part.upper() else 0.0)
    if not symbols and len(scripts) == 1:
        if _is_syllable(lower) or (len(part) <= 4 and shape == "U" * len(shape) and {c for c in lower if not c.isascii()} <= _VIETNAMESE):
            return uneven
        if all(c.isascii() or c in _FRENCH for c in lower):
            return uneven + 0.3
    odd = sum(not c.isascii() for c in part)
    return uneven + 0.4 + 0.4 * odd + 2.0 * len(_RARE.findall(part)) + symbols + (len(scripts) - 1)


_BLANKS = re.compile("([ \t\r\n]+)")


def text_cost(text: str) -> float:
    """The cost of all tokens of a text."""
    return sum(cost(t) for t in _BLANKS.split(text) if not t.isascii())


def _recoder(encoding: str) -> tuple[re.Pattern[str], dict[str, int]]:
    """Byte of each character of `encoding`, where bytes without one are C1 controls, and the pattern of UTF-8 sequences in them."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            c = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(byte)
        table[c] = byte

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    more = chars(0x80, 0xBF)
    return re.compile(f"{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{{2}}|{chars(0xF0, 0xF4)}{more}{{3}}"), table


_RECODERS = {e: _recoder(e) for e in WRONG}


#: A text is taken for another encoding's if its cost falls by at least this and to less than half.
LEAST_GAIN = 1.0


def _fix_sequence(m: re.Match[str], table: dict[str, int]) -> str:
    try:
        return bytes(table[c] for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _recode(token: str, encoding: str) -> str:
    """`token` with every UTF-8 sequence that was read as the single-byte `encoding` decoded."""
    pattern, table = _RECODERS[encoding]
    return pattern.sub(lambda m: _fix_sequence(m, table), token)


def _recode_wide(token: str, encoding: str) -> str:
    """`token` decoded as UTF-8 if it is what a multi-byte encoding made of it."""
    try:
        return token.encode(encoding).decode("utf-8")
    except UnicodeError:
        return token


#: The edges of the search within a token.
_TOKEN_EDGES: dict[str, Callable[[str], str]] = {
    **{f"utf-8 as {e}": (lambda t, e=e: _recode(t, e)) for e in WRONG},
    **{f"utf-8 as {e}": (lambda t, e=e: _recode_wide(t, e)) for e in MULTI},
    "unescape": lambda t: html.unescape(t) if "&" in t else t,
}


def _search(start: str, edges: Callable[[str, tuple[str, ...]], Iterator[tuple[str, str, tuple[str, ...]]]]) -> tuple[str, tuple[str, ...]]:
    """The cheapest text that the edges reach from `start`, and the operations on the way.

    Best first: of all texts reached, the one of least cost is expanded next;
    texts seen before are skipped by their hash, and a text may cost more
    than the one it comes from. The search ends at a text without cost or
    when all that can be reached has been. Only decodings count as damage: a
    text that is merely unescaped is as written and comes back unchanged. A
    way over a dearer text must gain at least `LEAST_GAIN` and more than half.
    """
    price = text_cost(start)
    heap: list[tuple[float, int, str, tuple[str, ...], float]] = [(price, 0, start, (), price)]
    seen, best = {hash(start)}, (price, start, ())
    while heap:
        cheap, _, current, path, peak = heapq.heappop(heap)
        if cheap < best[0] and any(p != "unescape" for p in path) and (peak <= price or (cheap <= price - LEAST_GAIN and cheap * 2 < price)):
            best = (cheap, current, path)
        if best[0] <= 0:
            break
        for _, new, way in edges(current, path):
            if hash(new) not in seen:
                seen.add(hash(new))
                dear = text_cost(new)
                # what escapes stand for is no dearer than they are
                heapq.heappush(heap, (dear, len(seen), new, way, peak if way[-1] == "unescape" else max(peak, dear)))
    return best[1], best[2]


@lru_cache(maxsize=1 << 16)
def _token(token: str) -> tuple[str, tuple[str, ...]]:
    """A blank-free token restored, and the operations. Every decoding makes it shorter, so all texts can be tried."""
    def edges(current: str, path: tuple[str, ...]) -> Iterator[tuple[str, str, tuple[str, ...]]]:
        if current.isascii() and "&" not in current:
            return
        for name, operation in _TOKEN_EDGES.items():
            new = operation(current)
            if new != current:
                yield name, new, (*path, name)

    return _search(token, edges) if text_cost(token) > 0 else (token, ())


_TCVN_RUN = re.compile("[\x00-\x7f" + "".join(map(re.escape, TCVN)) + "]*[" + "".join(map(re.escape, TCVN)) + "][\x00-\x7f" + "".join(map(re.escape, TCVN)) + "]*")
_VNI_ALL = "".join({*VNI_SINGLE, *VNI_MARK, *"".join(VNI_MARK).upper()})
_VNI_RUN = re.compile(f"[\x00-\x7f{_VNI_ALL}]*[{_VNI_ALL}][\x00-\x7f{_VNI_ALL}]*")
_VNI_PAIR = re.compile("([aeouyAEOUYôÔöÖ])([" + "".join({*VNI_MARK, *"".join(VNI_MARK).upper()}) + "])")


def _tcvn_word(word: str) -> str:
    new = "".join(TCVN.get(c, c) for c in word)
    plain = [c for c in word if c.isascii() and c.isalpha()]
    return new.upper() if plain and all(c.isupper() for c in plain) and len(plain) + sum(c in TCVN for c in word) > 1 else new


def _vni_word(word: str) -> str:
    def pair(m: re.Match[str]) -> str:
        base = VNI_SINGLE.get(m[1], m[1])
        return unicodedata.normalize("NFC", base + VNI_MARK[m[2].lower()])

    marked = _VNI_PAIR.sub(lambda m: "" + pair(m), word)
    out, i = [], 0
    while i < len(marked):
        if marked[i] == "":
            out.append(marked[i + 1])
            i += 2
        else:
            out.append(VNI_SINGLE.get(marked[i], marked[i]))
            i += 1
    return "".join(out)


def _by_runs(text: str, run: re.Pattern[str], word: Callable[[str], str]) -> str:
    """`text` with the runs of one encoding's characters decoded, line by line, where that makes Vietnamese of them."""

    def fix(m: re.Match[str]) -> str:
        old = m[0]
        before = text_cost(old)
        if before < LEAST_GAIN:
            return old
        new = "".join(t if t.isascii() else word(t) for t in _BLANKS.split(old))
        after = text_cost(new)
        return new if after <= before - LEAST_GAIN and after * 2 < before else old

    return "\n".join(run.sub(fix, line) if not line.isascii() else line for line in text.split("\n"))


@lru_cache(maxsize=None)
def _pair(true: str, read: str) -> tuple[dict[int, str], re.Pattern[str]]:
    """What each character of `read` is in `true`, and runs of text that `read` may have shown."""
    table = {}
    for byte in range(0x80, 0x100):
        # bytes without a character in `read` are shown as C1 controls
        if meant := bytes([byte]).decode(true, "ignore"):
            table[bytes([byte]).decode(read, "ignore") or chr(byte)] = meant
    chars = "".join(map(re.escape, table))
    return {ord(k): v for k, v in table.items()}, re.compile(f"[\x00-\x7f{chars}]*[{chars}][\x00-\x7f{chars}]*")


_PAIRS = [(t, r) for t in TRUE for r in READ if t != r]
#: Cost from which a line is looked at for a wrong pair of single-byte encodings; tokens up to this cost don't count.
PAIR_COST, _ACCENT = 2.0, 0.35


def _excess(text: str) -> float:
    """The cost of the different tokens that cost more than an accent; 0 if they are fewer than three, as a sign or name that is only unusual may be."""
    costs = [c for t in {*_BLANKS.split(text)} if not t.isascii() and (c := cost(t)) > _ACCENT]
    return sum(costs) if len(costs) > 2 else 0.0


def _by_pair(text: str, true: str, read: str) -> str:
    """`text` with the runs of `read`'s characters taken for `true`, where that takes most of their cost away."""
    table, run = _pair(true, read)

    def fix(m: re.Match[str]) -> str:
        before = _excess(m[0])
        if before < PAIR_COST:
            return m[0]
        new = unicodedata.normalize("NFC", m[0].translate(table)) if true == "cp1258" else m[0].translate(table)
        after = sum(c for t in {*_BLANKS.split(new)} if not t.isascii() and (c := cost(t)) > _ACCENT)
        return new if after <= before - PAIR_COST and after * 4 < before else m[0]

    return run.sub(fix, text)


def _lines(current: str, path: tuple[str, ...]) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """The edges of the search within a line: each token's own way, the fonts by runs of words, pairs of single-byte encodings, unescaping."""
    steps: list[str] = []
    out = []
    for token in _BLANKS.split(current):
        if not token.isascii() or "&" in token:
            token, way = _token(token)
            steps += [s for s in way if s not in steps]
        out.append(token)
    if steps:
        yield "tokens", "".join(out), (*path, *steps)
    for name, run, word in (("tcvn as cp1252", _TCVN_RUN, _tcvn_word), ("vni as cp1252", _VNI_RUN, _vni_word)):
        new = _by_runs(current, run, word)
        if new != current:
            yield name, new, (*path, name)
    # bytes that still are UTF-8 are no single-byte text; and one that was misread twice can't be told from one that was misread once
    if not steps and not any(p in _PAIR_NAMES for p in path) and _excess(current) >= PAIR_COST:
        for (true, read), name in zip(_PAIRS, _PAIR_NAMES):
            new = _by_pair(current, true, read)
            if new != current:
                yield name, new, (*path, name)
    if "&" in current and (new := html.unescape(current)) != current:
        yield "unescape", new, (*path, "unescape")


_PAIR_NAMES = [f"{t} as {r}" for t, r in _PAIRS]


def restore(text: str) -> tuple[str, list[str]]:
    """A line's cheapest reading and the operations that lead there: a search over the line whose steps are searches over its tokens."""
    if text_cost(text) <= 0 and not ("&" in text and html.unescape(text) != text):
        return text, []
    new, path = _search(text, _lines)
    return new, list(path)


def damaged(text: str) -> bool:
    """Whether signs of a wrong decoding remain that no operation explains: replacement or C1 control characters (but NEL)."""
    return bool(re.search("[�\x80-\x84\x86-\x9f]", text))


def examine(text: str, any_line: bool = False) -> tuple[bool, str, str, bool]:
    """Whether a text is garbled, its restored form, the operations used, and whether it is whole again.

    Each suspicious line is a search of its own, so a long text costs in
    proportion to its suspicious lines. With `any_line` the first garbled
    line is enough and no text is put together. A text is whole if neither
    damage nor a token of high cost is left in the lines that were garbled.
    """
    found, steps, whole = False, [], True
    lines = text.split("\n")
    held = []
    for i, line in enumerate(lines):
        if line.isascii() and "&" not in line:
            continue
        if not _SUSPICIOUS.search(line) and "&" not in line:
            held.append(i)
            continue
        new, path = restore(line)
        if path or damaged(line):
            found = True
            if any_line:
                return True, "", "", False
            whole = whole and not damaged(new) and all(cost(t) < LEAST_GAIN for t in _BLANKS.split(new) if not t.isascii())
        steps += [p for p in path if p not in steps]
        lines[i] = new
    for i in held if found else ():
        lines[i], path = restore(lines[i])
        steps += [p for p in path if p not in steps]
    return found, "\n".join(lines), ", ".join(steps), found and whole


_SUSPICIOUS = re.compile(SUSPECT)
_REFERENCE = "&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z]+);"


def garbled(df: DataFrame, doc_id: Column, text: Column, texts: bool = True) -> DataFrame:
    """The records whose text is, wholly or in places, the product of a wrong decoding.

    Gives `doc_id` and, with `texts`, `restored`, `operations` and `whole`
    (false if signs of damage remain). A text that has only characters of
    Vietnamese, ASCII and common punctuation in a usual order is no case and
    costs one scan; nor are null, empty and blank texts. Character references and other
    notations are as written unless what they stand for is garbled. Repeated
    rows give repeated results; no shuffle.
    """
    rows = df.select(doc_id.alias("doc_id"), text.alias("text")).where(F.length("text") > 0)
    fields = [rows.schema["doc_id"]] + ([T.StructField("restored", T.StringType()), T.StructField("operations", T.StringType()), T.StructField("whole", T.BooleanType())] if texts else [])
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pc.or_(pc.match_substring_regex(batch["text"], SUSPECT), pc.match_substring_regex(batch["text"], _REFERENCE))
            keep, restored, operations, whole = [], [], [], []
            for i in pc.indices_nonzero(near).to_pylist():
                found, new, steps, complete = examine(batch["text"][i].as_py(), any_line=not texts)
                if found:
                    keep.append(i)
                    restored.append(new)
                    operations.append(steps)
                    whole.append(complete)
            columns = [batch["doc_id"].take(pa.array(keep, pa.int64()))]
            if texts:
                columns += [pa.array(restored, pa.string()), pa.array(operations, pa.string()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
