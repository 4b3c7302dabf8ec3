"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

What a full stop, a line break or (in Thai) a space means is settled from unambiguous occurrences: first those elsewhere in
the same document (what follows a word's full stop there, words that also occur in lower case, capitalised words in
mid-sentence, line breaks in the middle of a phrase, marks of lists and speakers),
then, for what the document leaves open, those of the whole corpus. The corpus stage counts for each word before a full stop
what follows it: a small letter, a digit, a comma, a capital, or the end of a paragraph. A word that stands at the end of a paragraph far
more seldom than words before a capital do in this corpus cannot end a sentence (titles), nor one after which sentences mostly go on ("cf."); one followed mostly by digits announces a number ("vol."). For Thai segments it
counts how often they begin a line. Which marks end a sentence depends on the script of the text before them.

Texts are read once and never move: one pass over them gives the evidence and an outline of each document, its sentences as the fixed prior has
them and the places that hang on the corpus' verdict on a word, with the sentences either way. Only words whose verdict would change something are joined
with the verdicts, only outlines for which it does are settled anew, and nothing that grows with the corpus is sent to every worker.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import has_bit
from ..session import checkpoint

#: Verdicts on a word before a full stop or on the start of a Thai segment.
NEVER_FINAL, BEFORE_NUMBER, STARTS, CAN_END = 1, 2, 4, 8
#: Fixed prior, for corpora too small to tell: words never last in a sentence, and words that announce a number.
PRIOR_NEVER_FINAL = "dr mr mrs ms prof st sr sra dra mme vgl cf vs им ул см д डॉ ee".split()
PRIOR_BEFORE_NUMBER = "no nr vol p pp bd s ca art pág núm éd ed fig jan feb mar apr jun jul aug sep sept oct nov dec т с стр ص पृ".split()
#: Least number of occurrences for a verdict (the prior stays where that many cannot tell: fewer paragraph ends than expected, and too few expected); greatest share of paragraph ends and least share of small letters, digits and commas after a
#: word that is an abbreviation by these; least number of paragraph ends to be expected of a word that has almost none; least share of
#: digits after a word before numbers; least share of line starts of a Thai segment that begins sentences.
LEAST, FINAL_SHARE, GOES_ON, EXPECTED, NUMBER_SHARE, START_SHARE = 30, 0.004, 0.3, 7, 0.5, 0.03
#: Least number of unambiguous occurrences in a document that settle a word there.
SEVERAL = 2
#: Greatest number of words, or of characters in scripts without blanks, of a line that is taken for a heading without other signs; characters that stand
#: for the first word of a Thai segment, which no blank ends.
HEADING_WORDS, HEADING_CHARS, THAI_WORD = 7, 12, 6
#: German words before an ordinal number.
ORDINAL_AFTER = frozenset("am im dem den der des die das vom zum zur bis seit ab beim ins".split())

_WORD = r"[^\W\d_]+(?:[.\-][^\W\d_]+)*"
_STRONG = "!?。！？｡।॥։።፧؟‼⁇⁈⁉"
_STRONG_SET = frozenset(_STRONG)
_NO_SPACE = frozenset("。！？｡।॥։።፧؟")
_CANDIDATE = regex.compile(rf"[.…{_STRONG}]+(?:[ \xa0\u202f]+[!?]+(?!\w))?|(?<=\p{{Greek}}|\d);(?=\s|$)|(?: ?[\xa0 ])?[!?]+(?=\s|$)|\s*\n\s*|(?<=[\p{{Thai}}\d”\"])[^\S\n]+(?=\S)")
_MARK = regex.compile(r"(?:[ \t\xa0]*)(?:[-*•‣◦·–▪]\s+|\(?\d{1,3}(?:\.\d{1,3})*[.)]\s+|\d{1,3}(?:\.\d{1,3})+\s+(?=\p{L})|[\p{L}][\p{L} .]{0,15}?[ \xa0]?[:：]\s+(?=\S))")
_BULLET = regex.compile(r"[-*•‣◦▪]\s+|\(?\d{1,3}[.)]\s+\S|\d{1,2}(?:\.\d{1,2})+\s+\p{L}")
_SPEAKER = regex.compile(r"(?m)^[ \t]*(\p{L}{1,12})[ \xa0]?[:：][ \xa0]+\S")
_HEADING_NUMBER = regex.compile(r"\d{1,2}(?:\.\d{1,2})*\.?\s+\p{L}[^.!?]{0,60}$")
_QUOTES = regex.compile(r"[\"'“”„‟‘’‚«»‹›「」『』()（）\[\]【】《》]")
_PAIRS = {"「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
_PARENS = frozenset("(（[【")
_OPENING = frozenset("\"'“„‘‚«»‹「『(（[¿¡")
_THAI = regex.compile(r"[“\"‘(]?\p{Thai}")
_UNCASED_STOP = regex.compile(r"[\p{Devanagari}\p{Armenian}\p{Ethiopic}\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯]")
_BLANK_LINE = regex.compile(r"\n[^\S\n]*\n|\n[^\S\n]*\r?\n|\u2029")
_THAI_RUN, _THAI_CHAR = regex.compile(r"(?:^|(?<=\s))[“\"‘(]?\p{Thai}+"), regex.compile(r"(?r)\p{Thai}")
_SMALL, _CAPITAL, _HANGUL = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}"), regex.compile(r"\p{Hangul}")
_WRAP, _BREAK, _LIST = regex.compile(r"[\p{Ll}\d,]\r?\n[^\S\n]*\p{Ll}"), regex.compile(r"[^\s.!?…:;,。！？][^\S\n]*\n[^\S\n]*\S"), regex.compile(r"(?m)^[ \t]*(?:[-*•‣◦▪]|\d{1,3}[.)])[ \t]+\S")
_SMALL_WORD, _NAME, _CAPITALISED = regex.compile(r"(?<![\w'’])\p{Ll}+(?!\w)"), regex.compile(r"(?<=[\p{Ll},] )\p{Lu}\p{Ll}+(?!\w)"), regex.compile(r"\p{Lu}\p{Ll}+")
_SPOKEN, _FOREIGN = regex.compile(r"(\p{L}{1,12})[ \xa0]?[:：][ \xa0]+\S"), regex.compile(r"[¿¡«“\"„»]?[\p{Lu}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Devanagari}\p{Arabic}\p{Armenian}\p{Ethiopic}]")
_INITIALS, _SHORT_NUMBER, _NUMBERED = regex.compile(r"\p{Lu}(?:\.?-\p{Lu})+"), regex.compile(r"\d{1,2}\."), regex.compile(r"\d+[\p{Han}\p{Hangul}]")
# Matched backwards from a place.
_WORD_BEFORE, _NUMBER_BEFORE, _LETTERS_BEFORE = regex.compile(rf"(?r){_WORD}"), regex.compile(r"(?r)[\d.,]+"), regex.compile(r"(?r)(\p{L}+)\s+")
_YEAR_BEFORE, _DATE_BEFORE, _SPEAKER_BEFORE = regex.compile(r"(?r)\d{4}(?:\.\s\d{1,2}(?:\.\s\d{1,2})?)?"), regex.compile(r"(?r)\d{4}\.\s\d{1,2}\.\s\d{1,2}"), regex.compile(r"(?r)(?:^|\n)\s*\p{L}{1,12} ?:")
_PLAIN_WORDS = regex.compile(r"\S+")
#: Outcomes by verdict: a table has a bit for each combination of NEVER_FINAL (1), BEFORE_NUMBER (2) and CAN_END (4); of a Thai segment for whether it STARTS.
_NEVER, _ALWAYS, _UNLESS_NEVER, _UNLESS_EITHER, _IF_STARTS = 0b0000, 0b1111, 0b0101, 0b0001, 0b10


def word_type(word: str) -> str:
    """Key of a word before a full stop: lower case, but a single capital stays one."""
    return word if len(word) == 1 else word.lower()


def thai_type(text: str, at: int) -> str:
    return "th:" + text[at : at + THAI_WORD]


def evidence(text: str) -> dict[str, list[int]]:
    """Type -> counts of [final, capital or other letter, small letter, digit, comma and the like] after it; Thai: [line starts, others, 0, 0, 0]."""
    found: dict[str, list[int]] = {}
    n, dot = len(text), text.find(".")
    while dot >= 0:
        m, k = _WORD_BEFORE.match(text, 0, dot), dot + 1
        dot = text.find(".", k)
        if not m or m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_."):
            continue
        end = k
        while k < n and text[k].isspace():
            k += 1
        nxt = text[k] if k < n else ""
        if k == end and nxt and nxt not in ",;:)]":
            continue
        i = 0 if not nxt or k > end + 1 and _BLANK_LINE.search(text, end, k) or k == end + 1 and text[end] == "\u2029" else 2 if nxt.islower() else 3 if nxt.isdigit() else 4 if nxt in ",;:)]" else 1
        kind = word_type(m.group())
        if kind not in found:
            found[kind] = [0] * 5
        found[kind][i] += 1
    if "ก" <= max(text, default="") and _THAI.search(text):
        for m in _THAI_RUN.finditer(text):
            at = m.start()
            while at and text[at - 1] in " \t\xa0":
                at -= 1
            starts = not at or text[at - 1] == "\n" or bool(_SPEAKER_BEFORE.match(text, 0, at))
            found.setdefault(thai_type(text, m.start()), [0] * 5)[0 if starts else 1] += 1
    return found


def verdict(kind: str, final: int, other: int, small: int, digit: int, comma: int, base: float) -> int:
    """Flags of a type from its counts over the corpus, the prior included; ``base`` is the corpus' share of paragraph ends among ends and capitals."""
    if kind.startswith("th:"):
        return STARTS if final >= max(2, START_SHARE * (final + other)) else 0
    total, flags = final + other + small + digit + comma, 0
    goes_on = small + digit + comma >= GOES_ON * total and final <= FINAL_SHARE * total
    expected = base * (final + other)
    never = goes_on or expected >= EXPECTED and final <= 0.1 * expected
    if total >= LEAST and (never or expected >= EXPECTED or final and final >= expected):
        flags |= NEVER_FINAL if never else CAN_END
    elif kind in PRIOR_NEVER_FINAL:
        flags |= NEVER_FINAL
    open_ = final + other + digit
    if digit >= 3 and digit >= NUMBER_SHARE * open_ or (total < LEAST and kind in PRIOR_BEFORE_NUMBER):
        flags |= BEFORE_NUMBER
    return flags


def prior(kind: str) -> int:
    return (NEVER_FINAL if kind in PRIOR_NEVER_FINAL else 0) | (BEFORE_NUMBER if kind in PRIOR_BEFORE_NUMBER else 0)


def place(flags: int) -> int:
    """Place of a verdict in a table of outcomes."""
    return 1 if flags & STARTS else flags & 3 | (flags & CAN_END) >> 1


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """Outermost quotations and brackets (open, close, is bracket), none across a blank line."""
    spans: list[tuple[int, int, bool]] = []
    stack: list[tuple[int, str, bool]] = []
    wanted: Counter = Counter()  # closing marks that the stack waits for
    breaks = [m.start() for m in _BLANK_LINE.finditer(text)] if "\n" in text or "\u2029" in text else []
    b, n = 0, len(text)

    def push(i: int, end: str, paren: bool = False) -> None:
        stack.append((i, end, paren))
        wanted[end] += 1

    def close(c: str, at: int) -> None:
        both = c in "“”"
        if not (wanted["“"] or wanted["”"] if both else wanted[c]):
            return
        while stack:
            i, end, paren = stack.pop()
            wanted[end] -= 1
            if end == c or both and end in "“”":
                while spans and spans[-1][0] > i:
                    spans.pop()
                spans.append((i, at, paren))
                return

    for m in _QUOTES.finditer(text):
        i, c = m.start(), m.group()
        while b < len(breaks) and breaks[b] < i:
            stack.clear()
            wanted.clear()
            b += 1
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        left, right = before.isspace() or before in "([¿¡—–-:：「『（“«‘\"'", after.isspace() or not (after.isalnum() or after in "¿¡«“‘'\"—(…")
        expects = stack[-1][1] if stack else ""
        if c in _PAIRS:
            push(i, _PAIRS[c], c in _PARENS)
        elif c in "」』)）]】》":
            close(c, i)
        elif c == "„" or c == "‚":
            push(i, "“" if c == "„" else "‘")
        elif c == "“":
            if expects == "“":
                close("“", i)
            elif not right or _CJK.match(after) or left:
                push(i, "”")
        elif c in "”‟":
            close("”", i)
        elif c == "‘":
            close("‘", i) if expects == "‘" else push(i, "’")
        elif c == "’":
            if not after.isalpha():
                close("’", i)
        elif c in "«»‹›":
            other = {"«": "»", "»": "«", "‹": "›", "›": "‹"}[c]
            if expects == c and not (left and not right):
                close(c, i)
            elif c in "«‹" and (left or not right) or c in "»›" and left and not right:
                push(i, other)
            else:
                close(c, i)
        elif c == '"':
            if wanted['"'] and (right or not left):
                close('"', i)
            elif (left or before in ".!?…" and after.isalnum()) and not after.isspace():
                push(i, '"')
        elif c == "'":
            if wanted["'"] and not before.isspace() and not after.isalpha():
                close("'", i)
            elif before.isspace() and after.isalpha() and after.isupper():
                push(i, "'")
    spans.sort()
    outer: list[tuple[int, int, bool]] = []
    for s in spans:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer


class TooOpen(Exception):
    """More sentences hang on each other than an outline follows."""


class _Document:
    """Decisions in one text. Each is 0 (no end), 1 (an end), or a code from 2 on: it hangs on the verdict on a word (``kinds``) by a table of outcomes."""

    def __init__(self, text: str, own: dict[str, list[int]] | None = None):
        self.text, self.n = text, len(text)
        self.own_counts = evidence(text) if own is None else own
        self.spans = _spans(text) if _QUOTES.search(text) else []
        self.opens = [s[0] for s in self.spans]
        self.cased = bool(_CAPITAL.search(text))
        self.capitals = self.cased and not _SMALL.search(text)
        lines = "\n" in text
        speakers = Counter(m.group(1) for m in _SPEAKER.finditer(text)) if ":" in text or "：" in text else {}
        self.speakers = {s for s, k in speakers.items() if k > 1 or len(speakers) > 1}
        self.wraps = len(_WRAP.findall(text)) if lines else 0
        self.breaks = len(_BREAK.findall(text)) if lines else 0
        self.lists = bool(_LIST.search(text))
        self.kinds: dict[str, int] = {}
        self._small: set[str] | None = None
        self._names: set[str] | None = None
        self._blanks: list[int] | None = None
        self._hangul: bool | None = None

    def open(self, kind: str, table: int) -> int:
        return 2 + (self.kinds.setdefault(kind, len(self.kinds)) << 8 | table)

    def has_blanks(self, start: int, end: int) -> bool:
        """Whether more than two blanks lie between two places."""
        if self._blanks is None:
            self._blanks = [i for i, c in enumerate(self.text) if c == " "]
        return bisect_left(self._blanks, end) - bisect_left(self._blanks, start) > 2

    def hangul(self) -> bool:
        if self._hangul is None:
            self._hangul = bool(_HANGUL.search(self.text))
        return self._hangul

    def span_at(self, i: int) -> tuple[int, int, bool] | None:
        j = bisect_right(self.opens, i) - 1
        return self.spans[j] if j >= 0 and self.spans[j][1] >= i else None

    def skip(self, i: int) -> int:
        while i < self.n and self.text[i].isspace():
            i += 1
        return i

    def own_flag(self, word: str, flags: int) -> int:
        """Flags of a word by its unambiguous occurrences in the document, 0 if they don't settle it; digits alone make no abbreviation of a word that can end a sentence."""
        final, other, small, digit, comma = self.own_counts.get(word_type(word), (0, 0, 0, 0, 0))
        if final:
            return CAN_END if final >= SEVERAL and not small + digit + comma else 0
        number = BEFORE_NUMBER if digit >= SEVERAL and digit > other else 0
        goes_on = small + digit + comma >= SEVERAL and (small + comma or not flags & CAN_END)
        return number | (NEVER_FINAL if goes_on else 0)

    def mark_end(self, start: int) -> int:
        """Where the content of a sentence begins after a bullet, number or speaker's mark."""
        m = _MARK.match(self.text, start)
        return m.end() if m and m.end() > start else start

    def marked(self, k: int) -> bool:
        """Whether a line that begins at k begins with a bullet, number or speaker's mark."""
        if _BULLET.match(self.text, k):
            return True
        m = _SPOKEN.match(self.text, k) if self.speakers else None
        return bool(m) and m.group(1) in self.speakers

    def after_quote(self, start: int, span: tuple[int, int, bool], e: int, k: int) -> bool:
        """Whether a sentence ends after a quotation or bracket that closes just after a mark of a sentence's end."""
        text, nxt = self.text, self.text[k]
        if nxt.islower() and self.cased and not self.capitals or nxt in ",;:،、，；：)]）·":
            return False
        if nxt in "—–-" and not self.dash_starts(k):
            return False
        lead = self.skip(self.mark_end(start))
        while lead < span[0] and (s := self.span_at(lead)) and s[0] == lead and not s[2]:
            lead = self.skip(s[1] + 1)
        while lead < span[0] and (text[lead] in "¿¡" or text[lead].isspace()):
            lead += 1
        introduced = lead < span[0]
        if span[2]:
            return not introduced or not nxt.isalpha() or nxt.isupper() or bool(_CJK.match(nxt))
        if nxt in "とって라이고":
            return False
        if introduced:
            return True
        chain, at = span, k
        while at < self.n and (s := self.span_at(at)) and s[0] == at and not s[2]:
            chain, at = s, self.skip(s[1] + 1)
        if chain is not span:
            last = text[at] if at < self.n else ""
            return not (last.islower() or last in ",，、" and last) if not self.capitals else not last.isalpha()
        if self.capitals:
            return not nxt.isalpha()
        if nxt.isalpha() and not nxt.isupper():
            return not (e == k or nxt.isalpha())
        return True

    def dash_starts(self, k: int) -> bool:
        """Whether a dash at k begins a sentence (a bullet or speech) rather than going on with one."""
        j = k
        while j < self.n and (self.text[j] in "—–-" or self.text[j].isspace()):
            j += 1
        return j < self.n and not self.text[j].islower()

    def ordinal(self, start: int, at: int, a: int, k: int) -> bool:
        """Whether the full stop after the number at..a belongs to it: an item of a list, a date, an ordinal."""
        text, nxt, num = self.text, self.text[k], self.text[at:a]
        if not num.isdigit():
            return False
        if self.skip(start) == at and len(num) <= 3:
            j = at
            while j and text[j - 1].isspace() and text[j - 1] != "\n":
                j -= 1
            if at == 0 or self.lists or j and text[j - 1] == "\n" or len(num) <= 2 and not nxt.isdigit():
                return True
        if _YEAR_BEFORE.match(text, start, a) and self.hangul():
            if nxt.isdigit() and _SHORT_NUMBER.match(text, k) or len(num) <= 2 and _DATE_BEFORE.match(text, start, a):
                return True
        if len(num) <= 2 and nxt.isalpha():
            before = _LETTERS_BEFORE.match(text, start, at)
            return bool(before) and before.group(1).lower() in ORDINAL_AFTER
        return False

    def stop(self, start: int, a: int, e: int, k: int) -> int:
        """Whether a single full stop at a ends a sentence whose next character is at k."""
        text, nxt = self.text, self.text[k]
        if a > start and text[a - 1].isdigit():
            return int(not self.ordinal(start, _NUMBER_BEFORE.match(text, start, a).start(), a, k))
        m = _WORD_BEFORE.match(text, start, a)
        if not m:
            return 1
        word = m.group()
        if _UNCASED_STOP.match(word[-1]):
            return 0
        if len(word) == 1 and word.isupper() or _INITIALS.fullmatch(word):
            if not nxt.isdigit():
                return int(self.initial_ends(k))
            table = _UNLESS_EITHER | _UNLESS_EITHER << 4
        else:
            half = []
            for can in (0, CAN_END):
                own = self.own_flag(word, can)
                if nxt.isdigit():
                    half.append((_ALWAYS if own & CAN_END else _NEVER) if own and not can else _UNLESS_EITHER)
                elif own & NEVER_FINAL:
                    half.append(_ALWAYS if self.initial_ends(k) or can and not self.name_at(k) else _NEVER)
                else:
                    half.append(_ALWAYS if own & CAN_END else _UNLESS_NEVER)
            table = half[0] | half[1] << 4
        return self.open(word_type(word), table) if 0 < table < 255 else int(table > 0)

    def small_words(self) -> set[str]:
        """Words that the document has in small letters."""
        if self._small is None:
            self._small = set(_SMALL_WORD.findall(self.text))
        return self._small

    def names(self) -> set[str]:
        """Words that the document has with a capital in mid-sentence."""
        if self._names is None:
            self._names = set(_NAME.findall(self.text))
        return self._names

    def name_at(self, k: int) -> bool:
        """Whether the word at k has a capital in mid-sentence elsewhere in the document."""
        word = _CAPITALISED.match(self.text, k)
        return bool(word) and word.group() in self.names()

    def initial_ends(self, k: int) -> bool:
        """Whether a sentence ends after a single capital or an abbreviation: the next word occurs in small letters elsewhere in the document and not with a capital in mid-sentence, so it is no name."""
        word = _CAPITALISED.match(self.text, k)
        return bool(word) and word.group().lower() in self.small_words() and word.group() not in self.names()

    def glued(self, start: int, a: int, got: str, k: int) -> bool:
        """Whether a mark without a blank after it may end a sentence: the next one begins plainly and no address or number goes on."""
        text, nxt = self.text, self.text[k]
        last, word = text[a - 1 : a], text[k : k + 2]
        if got[-1] in "!?":
            return bool(_CJK.match(nxt) and _CJK.match(last)) or nxt.isupper() or nxt in _OPENING
        if got != "." or not (last.islower() or last.isdigit() or last in "”»)\"" or _CJK.match(last)):
            return False
        if _CJK.match(nxt):
            return self.has_blanks(start, a)
        if nxt.isdigit():
            return last.islower() and self.has_blanks(start, a) and bool(_NUMBERED.match(text, k))
        return nxt in "“„«»\"¿¡—(" or nxt.isupper() and (len(word) == 2 and (word[1].islower() or word[1] in " .'’"))

    def line_break(self, start: int, a: int, e: int) -> int:
        """Whether a break at a..e after text without a mark of its end ends a sentence (a heading, a list item)."""
        text = self.text
        if _BLANK_LINE.search(text, a, e):
            return 1
        nxt, last = text[e], text[a - 1 : a]
        if self.marked(e):
            return 1
        if _THAI.match(text, e) and _THAI_CHAR.search(text, start, a):
            return self.open(thai_type(text, e), _IF_STARTS)
        if nxt in "—–-" and not self.dash_starts(e):
            return 0
        if self.cased and nxt.islower() or nxt in ",;:)]»”…!?%％" or last in ",-–—(:،、，":
            return 0
        m = _MARK.match(text, start)
        spoken = bool(m) and m.group().strip().endswith((":", "："))
        first = self.skip(start)
        if m and (not spoken or self.wraps == 0) or _HEADING_NUMBER.match(text, first, a):
            return 1
        if _CJK.match(last):
            return int(a - first <= HEADING_CHARS or self.wraps == 0)
        if self.wraps or self.capitals and not self.lists:
            return 0
        words = sum(1 for _ in islice(_PLAIN_WORDS.finditer(text, start, a), HEADING_WORDS + 1))
        if nxt.isdigit() and not self.lists and self.breaks <= 2:
            return int(words <= 3)
        return int(words <= HEADING_WORDS or self.lists or self.breaks > 2)

    def space(self, start: int, a: int, e: int) -> int:
        """Whether a space in Thai text ends a sentence."""
        text = self.text
        if not _THAI_CHAR.search(text, start, a):
            return 0
        if text[a - 1] in "”»\"’" and _THAI.match(text, e):
            return int(text[e] in _OPENING)
        if _THAI.match(text, e):
            return self.open(thai_type(text, e), _IF_STARTS)
        return int(text[a - 1] not in "ๆ" and bool(_FOREIGN.match(text, e)))

    def ends(self, start: int, a: int, got: str, span: tuple[int, int, bool] | None, e: int, k: int) -> int:
        """Whether the mark ``got`` at a, closed at e, ends the sentence, the next one beginning at k."""
        text, nxt = self.text, self.text[k]
        if "\n" in text[e:k] and (_BLANK_LINE.search(text, e, k) or self.marked(k)):
            return 1
        if span:
            return int(self.after_quote(start, span, e, k))
        if nxt in ",;:،、，；" or nxt in ")]）" and e == k or nxt.islower() and self.cased or nxt in "—–-" and not self.dash_starts(k):
            return 0
        dots = not got.strip(".")
        if "…" in got and not set(got) & _STRONG_SET or dots and len(got) > 1:
            return int(nxt.isupper() or nxt in _OPENING and nxt not in "(（")
        return self.stop(start, a, e, k) if dots else 1

    def outline(self, flags: dict[str, int] | None = None) -> tuple[list[tuple[int, int]], list[tuple]]:
        """Sentences that hang on no verdict, and the places of the stretches between them that do. With ``flags`` given, all sentences and no place.

        A place is (starts, codes, end, next): where the sentence there may have begun, the decision for each, where it would end and
        the next one begin; one that is decided alike for all has no starts. A stretch begins with a place of one start and ends with an end that is certain, whatever the start.
        Raises ``TooOpen`` where more than ``WAYS`` starts are possible at once.
        """
        text, n = self.text, self.n
        fixed: list[tuple[int, int]] = []
        places: list[tuple] = []
        starts = [self.skip(0)]
        done, pending = starts[0], 0

        def at(codes: list[int], end: int, k: int) -> None:
            nonlocal starts, pending
            while end > starts[0] and text[end - 1].isspace():
                end -= 1
            sure = codes.count(1) == len(codes)
            if sure and not pending:
                if end > starts[0]:
                    fixed.append((starts[0], end))
            elif pending and codes.count(codes[0]) == len(codes):
                places.append((None, codes[:1], end, k))
            else:
                places.append((starts, codes, end, k))
            pending = 0 if sure else 1
            starts = [k] if sure else [*(s for s, c in zip(starts, codes) if c != 1), k]
            if len(starts) > WAYS:
                raise TooOpen

        def told(codes: list[int]) -> list[int]:
            return codes if flags is None else [outcome(c, list(self.kinds), flags) if c > 1 else c for c in codes]

        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            if a < done:
                if b <= done:
                    continue
                a = done
            got = text[a:b]
            span = self.span_at(a) if self.spans else None
            if span and span[0] >= a:
                span = None
            if not got.strip():
                e = self.skip(a)
                if e < n and not span:
                    ask = self.line_break if "\n" in got else self.space
                    codes = told([ask(s, a, e) if a > s else 0 for s in starts])
                    if any(codes):
                        at(codes, a, e)
                        done = max(done, e)
                continue
            e = b
            if span:
                inner = self.skip(b)
                while inner < span[1] and (text[inner] in "\"'”’»“)）」』.!?" or text[inner].isspace()):
                    inner += 1
                if inner < span[1]:
                    continue
                e = span[1] + 1
                if text[e : e + 1] in ("”", "»", '"', "'", "’", ")"):
                    e += 1
                if e < n and text[e] in _STRONG + ".":
                    span = None
                    while e < n and text[e] in _STRONG + ".":
                        e += 1
            elif got[-1] in _NO_SPACE:
                while e < n and text[e] in "”’」』）)»\"'":
                    e += 1
            k = self.skip(e)
            if k >= n:
                break
            loose = span is None and k == e and got[-1] not in _NO_SPACE
            if len(starts) > 1 and not loose and span is None and not text[a - 1].isdigit() and text[starts[-1] - 1].isspace():
                codes = [self.ends(starts[-1], a, got, span, e, k)] * len(starts)  # the word before the mark is the same wherever the sentence began
                done = k
            else:
                codes = [-1 if loose and not self.glued(s, a, got, k) else self.ends(s, a, got, span, e, k) for s in starts]
                if max(codes) >= 0:
                    done = k
                codes = [c if c > 0 else 0 for c in codes]
            codes = told(codes)
            if any(codes):
                at(codes, e, k)
        if starts[0] < n:
            at([1] * len(starts), n, n)
        return fixed, places


def outcome(code: int, kinds: list[str], flags: dict[str, int]) -> int:
    """What a decision that hangs on a verdict comes to."""
    kind = kinds[code - 2 >> 8]
    return (code - 2 & 255) >> place(flags.get(kind, prior(kind))) & 1


def settle(places: list[tuple], kinds: list[str], flags: dict[str, int]) -> list[tuple[int, int]]:
    """Sentences of the stretches of an outline, given flags of words; others have those of the prior."""
    out: list[tuple[int, int]] = []
    start = 0
    for starts, codes, end, k in places:
        if starts and len(starts) == 1:
            start = starts[0]
        code = codes[starts.index(start)] if starts else codes[0]
        if outcome(code, kinds, flags) if code > 1 else code:
            if end > start:
                out.append((start, end))
            start = k
    return out


def split_text(text: str | None, flags: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text in code points; ``flags`` are the corpus' verdicts on its words."""
    if not text or text.isspace():
        return []
    return _Document(text).outline(flags or {})[0]


_EVIDENCE = ["final", "other", "small", "digit", "comma"]
#: Starts of a sentence that an outline follows at once. A document with more is taken along as a text and split when the verdicts are known.
WAYS = 64
#: Words whose counts a task holds before it hands them on.
HELD = 100_000


def _flat(places: list[tuple]) -> list[int]:
    return [x for starts, codes, end, k in places for x in (len(starts or ()), end, k, *(starts or ()), *codes)]


def _places(flat: list[int]) -> list[tuple]:
    out, i = [], 0
    while i < len(flat):
        n, end, k = flat[i : i + 3]
        out.append((flat[i + 3 : i + 3 + n] or None, flat[i + 3 + n : i + 3 + n + max(1, n)], end, k))
        i += 3 + n + max(1, n)
    return out


def outlines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts: for each document with sentences ``ends`` (starts and ends by the prior), ``places`` that hang on verdicts, ``kinds`` of
    the words they hang on and ``changes``, the verdicts that would change something (bits by ``place``), ``whole`` texts too open for places; and rows of counts of kinds, without a key."""
    ints, texts = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("ends", ints), ("places", ints), ("kinds", texts), ("changes", ints), ("whole", T.StringType()), ("counts", T.ArrayType(T.LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        ints, texts, longs = pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())

        def handed_on(kind: pa.DataType) -> pa.RecordBatch:
            found = list(counts.items())
            counts.clear()
            rows = [found[i : i + 1000] for i in range(0, len(found), 1000)]
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(none, kind), pa.array(none, ints), pa.array(none, ints), pa.array([[k for k, _ in r] for r in rows], texts), pa.array(none, ints), pa.array(none, pa.string()), pa.array([[x for _, c in r for x in c] for r in rows], longs)], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            rows, columns = [], [[] for _ in range(5)]
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t or t.isspace():
                    continue
                own = evidence(t)
                for word, c in own.items():
                    if word in counts:
                        counts[word] = [x + y for x, y in zip(counts[word], c)]
                    else:
                        counts[word] = c
                try:
                    document = _Document(t, own)
                    fixed, places = document.outline()
                except TooOpen:
                    kinds, ends = list(own), _Document(t, own).outline({})[0]
                    places, changes, whole = [], [255] * len(kinds), t
                else:
                    kinds, whole = list(document.kinds), None
                    ends = sorted([*fixed, *settle(places, kinds, {})]) if places else fixed
                    changes = [0] * len(kinds)
                    for c in (c for p in places for c in p[1] if c > 1):
                        changes[c - 2 >> 8] |= (c - 2 & 255) ^ (255 if outcome(c, kinds, {}) else 0)
                rows.append(i)
                for column, x in zip(columns, ([x for s in ends for x in s], _flat(places), kinds, changes, whole)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (ints, ints, texts, ints, pa.string()))), pa.nulls(len(rows), longs)], names=schema.names)
            if len(counts) > HELD:
                yield handed_on(kind)
        if counts:
            yield handed_on(kind)

    return checkpoint(df.select(key, text).mapInArrow(run, schema))


def corpus_verdicts(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The outlines of the documents, and (kind, flags) of the corpus' verdicts."""
    seen = outlines(df, key, text)
    counted = seen.filter(F.col("counts").isNotNull()).select(F.posexplode("kinds").alias("_i", "kind"), "counts")
    totals = counted.groupBy("kind").agg(*(F.sum(F.get("counts", F.col("_i") * len(_EVIDENCE) + i)).alias(c) for i, c in enumerate(_EVIDENCE)))
    f, o, s, d, c = (F.col(x) for x in _EVIDENCE)
    total, thai = f + o + s + d + c, F.col("kind").startswith("th:")
    known, early = total >= LEAST, total < LEAST
    ends = totals.filter(~F.col("kind").startswith("th:")).agg(F.sum("final").alias("f"), F.sum("other").alias("o")).first()
    expected = F.lit((ends["f"] or 0) / max(1, (ends["f"] or 0) + (ends["o"] or 0))) * (f + o)
    never = ((s + d + c >= GOES_ON * total) & (f <= FINAL_SHARE * total)) | ((expected >= EXPECTED) & (f <= 0.1 * expected))
    word = (
        F.when(known & never, NEVER_FINAL).when(known & ((expected >= EXPECTED) | ((f > 0) & (f >= expected))), CAN_END).when(F.col("kind").isin(PRIOR_NEVER_FINAL), NEVER_FINAL).otherwise(0)
        + F.when(((d >= 3) & (d >= NUMBER_SHARE * (f + o + d))) | (early & F.col("kind").isin(PRIOR_BEFORE_NUMBER)), BEFORE_NUMBER).otherwise(0)
    )
    starts = F.when(f >= F.greatest(F.lit(2), START_SHARE * (f + o)), STARTS).otherwise(0)
    return seen.filter(F.col("counts").isNull()).drop("counts"), totals.select("kind", F.when(thai, starts).otherwise(word).alias("flags"))


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ``sent_start``, ``sent_end`` of each sentence, in code points from 0, the end exclusive, blanks left out.

    Null, empty and blank texts have none. ``key`` is unique; other columns are left out. Repeated texts are split each alike. An empty
    table gives no rows.
    """
    documents, verdicts = corpus_verdicts(df, key, text)
    asked = documents.filter(F.size("kinds") > 0).select(F.col(key).alias("_key"), F.explode(F.arrays_zip("kinds", "changes")).alias("_x")).select("_key", F.col("_x.kinds").alias("kind"), F.col("_x.changes").alias("changes"))
    at = F.when(F.col("flags") == STARTS, 1).otherwise(F.col("flags").bitwiseAND(F.lit(3)) + F.col("flags").bitwiseAND(F.lit(CAN_END)) / 2).cast("int")
    told = asked.join(verdicts.filter("flags != 0"), "kind").filter(has_bit(F.col("changes"), at))
    told = told.groupBy("_key").agg(F.collect_list(F.struct("kind", "flags")).alias("_told"))
    schema = T.StructType([df.schema[key], T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).to_pylist()
            told = batch.column(5).to_pylist()
            for i in [i for i, x in enumerate(told) if x is not None]:
                places, kinds, whole, flags = _places(batch.column(2)[i].as_py()), batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), {x["kind"]: x["flags"] for x in told[i]}
                if whole is not None:
                    ends[i] = [x for s in split_text(whole, flags) for x in s]
                    continue
                stretches: list[list[int]] = []  # first and last place of each
                for starts, codes, end, k in places:
                    if starts and len(starts) == 1:
                        stretches.append([starts[0], end])
                    stretches[-1][1] = end
                begins = [s for s, _ in stretches]
                within = lambda s: (j := bisect_right(begins, s) - 1) >= 0 and s < stretches[j][1]  # noqa: E731, B023
                kept = [(s, e) for s, e in zip(ends[i][::2], ends[i][1::2]) if not within(s)]
                ends[i] = [x for s in sorted([*kept, *settle(places, kinds, flags)]) for x in s]
            rows = [i for i, x in enumerate(ends) for _ in range(len(x) // 2)]
            flat = [x for e in ends for x in e]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(flat[::2], pa.int32()), pa.array(flat[1::2], pa.int32())], names=schema.names)

    met = documents.join(told, F.col(key) == F.col("_key"), "left")
    needed = lambda c: F.when(F.col("_told").isNotNull(), F.col(c)).alias(c)
    return met.select(key, "ends", needed("places"), needed("kinds"), needed("whole"), "_told").mapInArrow(run, schema)
