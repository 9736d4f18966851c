"""Text statistics of documents, and which documents are natural prose.

A text is cut into units: runs of lines under the same line mark (comment
signs, quote signs, bullets, speakers ...), whose mark is taken off, for prose
stays prose whatever its lines carry. Of each unit the function words, the
steps between function and content words and the character classes are
compared, by Jensen-Shannon divergence, with the prose of its language; the
divergences and basic counts, each cut into bands, are its description. A
structural profile is a distribution over the bands of every coordinate; the
unit takes the nearest one, by the weighted sum of the Jensen-Shannon
divergences of its coordinates. A document is no natural prose if units of
other shapes hold more than half of its characters.

Profiles are fitted on a bounded sample of hand-labelled documents and a few
examples of each shape that are part of this module, so that the method is the
same whatever labels there are. Units of a batch are measured together on
arrays of characters; no step runs word by word.
"""

from __future__ import annotations

import contextlib
import ctypes
import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that profiles are fitted on: those of the lowest hash.
MOST_LABELLED = 4_000
SHAPES = ("prose", "list", "table", "code", "junk")

#: Common function words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": """the a an of to in on at by for from with without and or but if than then that this these those it its is are was were be been
        being has have had do does did not no nor so as we our us you your they their them he she his her i my me who which what when where why how
        there here can could may might must shall should will would out up down over under again once only every each some any all both either
        one more most other another before after until while because although since even also still back never always already yet about into
        through between off them too very just than""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber wenn dann dass weil so als wie ist sind war waren sein
        hat haben hatte wird werden wurde nicht kein keine nur noch schon auch er sie es wir ihr ich man sich mit ohne von vom zu zum zur in im
        an am auf aus bei nach vor für über unter durch bis um solange damit denn doch hier dort alle jede jeder was wer wo warum mehr""",
    "es": """el la los las un una unos unas de del a al en con sin por para y o pero si que no es son era eran ser ha han hay lo le les se su
        sus este esta estos ese esa eso esto también ya solo más muy cuando donde como porque antes después desde hasta entre sobre ni ahí
        otra otro vez qué sé yo él ella nos todo todos cada""",
    "fr": """le la les un une des de du à au aux en dans sur sous avec sans pour par et ou mais si que qui quoi où quand comme ne pas plus
        est sont était être a ont avait été il elle ils elles on nous vous je ce cet cette ces c' l' d' n' s' qu' j' cela ça encore déjà trop
        tout tous son sa ses leur avant après il y reste là même""",
}
_FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
#: Particles and endings that run through Japanese prose.
_KANA = "はがをにでのともからまたいるますしたことなれ"
#: Languages with a list of function words, and Japanese by its kana.
LANGUAGES = (*FUNCTION_WORDS, "ja")

#: Examples that every fit begins with: (shape, text).
EXAMPLES = (
    ("prose", "The second run was slower than the first, because the cache had not been filled yet. We will look at it again once the report is in."),
    ("prose", "If you open the page before the job has ended, it shows what was there on the day before. That is not a fault, but it should be said somewhere."),
    ("prose", "I could not find out who keeps this file,\nand nobody whom I asked was able to tell me.\nSo I left it as it is and wrote a note."),
    ("prose", "Der zweite Lauf war langsamer als der erste, weil der Speicher noch nicht gefüllt war. Wir sehen es uns noch einmal an, wenn der Bericht da ist."),
    ("prose", "El segundo intento fue más lento que el primero, porque la memoria no estaba llena todavía. Lo vamos a mirar otra vez cuando esté el informe."),
    ("prose", "Le second essai était plus lent que le premier, parce que la mémoire n'était pas encore pleine. Nous allons le revoir quand le rapport sera là."),
    ("prose", "二回目の実行は一回目より遅かったです。まだ記憶が空だったからだと思います。報告が出たらもう一度見ることにします。"),
    ("list", "apples\npears\ntwo loaves of bread\nmilk\na box of eggs\nsoap\ncoffee"),
    ("list", "open tickets\nnext release\nowner of the page\nold reports\nnew tests\nmissing names"),
    ("list", "red, green, dark blue, light grey, black, white, brown, yellow, pink, violet, orange"),
    ("table", "name;size;owner\nalpha;12;ann\nbeta;7;bob\ngamma;31;cy\ndelta;4;dan"),
    ("table", "| name | size |\n|------|------|\n| one  | 12   |\n| two  | 7    |\n| six  | 31   |"),
    ("table", "city      people    area\nnorth     1200      34\nsouth     870       21\nwest      45        3"),
    ("code", "def area(w, h):\n    if w < 0:\n        raise ValueError(w)\n    return w * h"),
    ("code", "for (int i = 0; i < n; i++) {\n\tsum += values[i];\n}\nprintf(\"%d\\n\", sum);"),
    ("code", "server:\n  port: 8080\n  host: localhost\nlog:\n  level: debug\n  file: /var/log/app.log"),
    ("code", "2024-05-01T10:00:00Z INFO app.main started port=8080\n2024-05-01T10:00:02Z WARN app.db slow query ms=412"),
    ("junk", "#@!{]92 )(*&^ 0x%%1 ~~|/ 8[[ ;;: =+-_ <>?? 77#@"),
    ("junk", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    ("junk", "the of and to the is of in and the to was for of with the and at to of the in is and of the"),
    ("junk", "==========\n==========\n=========="),
)

_MARK = re.compile(
    r"^[ \t]*((?:(?://+!?|/\*+|\*+/|#+!?|>+|--+|;+|%+|<!--|(?:\*|[-+•‣▪◦·–—])(?=[ \t])|\d{1,3}[.)](?=[ \t])|[a-z][.)](?=[ \t])|\[[ xX]\](?=[ \t]))[ \t]*)+)"
)
_SPEAKER = re.compile(r"^[ \t]*([\w.@-]{2,24}:[ \t]+)(?=\S)")
_RUN, _NUMBER = re.compile(r"\s+"), re.compile(r"\d+")
#: Characters after which a unit is cut, so that the memory it takes to measure is bounded however long a text or a line is.
UNIT_CHARS = 1_000_000


def units(text: str) -> list[tuple[str, list[str], int]]:
    """Runs of lines under one mark: the mark's kind, the lines without it, the characters they take.

    Runs and lines of more than ``UNIT_CHARS`` characters are several units.
    """
    out: list[tuple[str, list[str], int]] = []
    kind_before: str | None = None
    lines: list[str] = []
    total = 0
    for line in _bounded_lines(text):
        bare = line.strip()
        if not bare:
            kind_before = None if kind_before is None or not kind_before.startswith(("//", "#", ">")) else kind_before
            continue
        # a mark begins with a sign or a digit, or is a single letter before a dot or bracket
        mark = _MARK.match(line) if not bare[0].isalpha() or bare[1:2] in (".", ")") else None
        if mark:
            body = line[mark.end() :]
            kind = _RUN.sub(" ", _NUMBER.sub("1", mark.group(1))).strip()
            if kind[0] == "#" and kind_before != kind:
                kind = "#"
            if "[" in kind:
                kind = "[]"
        else:
            body, kind = line.strip(" \t\r"), ""
            if ":" in bare[:25] and (who := _SPEAKER.match(line)) and len(line) - who.end() > 24:
                body, kind = line[who.end() :], "who:"
        if lines and kind == kind_before and total + len(bare) <= UNIT_CHARS:
            lines.append(body)
            total += len(bare)
        else:
            if lines:
                out.append((unit_kind, lines, total))
            unit_kind, lines, total = kind, [body], len(bare)
        kind_before = kind
    if lines:
        out.append((unit_kind, lines, total))
    return out


def _bounded_lines(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        if len(line) <= UNIT_CHARS:
            yield line
        else:
            yield from (line[i : i + UNIT_CHARS] for i in range(0, len(line), UNIT_CHARS))


def jsd(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits, 0 to 1."""
    return float(jsds(p[None, :], q)[0])


def jsds(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of each row of ``p`` from ``q`` (one for all, or row by row)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.clip((a + b) / 2, 0.0, 1.0)


# ---- characters -------------------------------------------------------------------------------------------------------

(
    VOWEL, CONSONANT, CAPITAL, DIGIT, SPACE, BREAK, COMMA, STOP, PUNCTUATION, SYMBOL, ACCENTED, LATIN, PARTICLE, HIRAGANA, KATAKANA, KANJI, BOX, WIDE,
    SCRIPT, OTHER,
) = range(20)
N_CLASSES = 20


def _classes() -> np.ndarray:
    """Class of every character of the basic plane."""
    out = np.full(65_536, OTHER, dtype=np.uint8)
    for c in range(65_536):
        ch = chr(c)
        if c < 128:
            out[c] = (
                VOWEL if ch in "aeiouy" else CONSONANT if "a" <= ch <= "z" else CAPITAL if "A" <= ch <= "Z" else DIGIT if "0" <= ch <= "9"
                else SPACE if ch == " " else BREAK if ch in "\n\r\t\x0b\x0c" else COMMA if ch == "," else STOP if ch in ".!?'" else PUNCTUATION if ch in ";:()\"-" else SYMBOL
            )
        elif c in (0xA0, 0x3000):
            out[c] = SPACE
        elif ch in _KANA:
            out[c] = PARTICLE
        elif 0x3040 <= c < 0x30A0:
            out[c] = HIRAGANA
        elif 0x30A0 <= c < 0x3100:
            out[c] = KATAKANA
        elif 0x4E00 <= c < 0xA000:
            out[c] = KANJI
        elif 0x2500 <= c < 0x2600:
            out[c] = BOX
        elif 0x3000 <= c < 0x3040 or 0xFF00 <= c < 0xFF66:
            out[c] = WIDE
        elif ch.isalpha():
            out[c] = (ACCENTED if ch in "áéíóúäöüàèêîôûâ" else LATIN) if c < 0x250 else SCRIPT
    return out


_CLASS = _classes()
_PLANE = [chr(c) for c in range(65_536)]
_LETTER = np.array([ch.isalpha() for ch in _PLANE])
_UPPER = np.array([ch.isupper() for ch in _PLANE])
_LOWER = np.array([ch.islower() for ch in _PLANE])
_WORDY = np.array([ch.isalnum() or ch == "_" for ch in _PLANE])
_BLANK = np.array([ch.isspace() for ch in _PLANE])
_FOLD = np.array([ord(ch.lower()) if len(ch.lower()) == 1 else c for c, ch in enumerate(_PLANE)], dtype=np.uint16)
_FOLD[ord("’")] = ord("'")


def _among(chars: str) -> np.ndarray:
    out = np.zeros(65_536, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_ENDING, _OPEN_END, _FULL_STOP = _among(".!?。！？:;,"), _among(".!?:;,|"), _among(".!?。！？")
_CUT, _CUT_STOP, _CELL = _among(",;|│·\t、\n"), _among(".!?:。！？"), _among("\t|;│,")

_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        step = np.full(n, base, dtype=np.uint64)
        step[:1] = 1
        out.append(np.cumprod(step, dtype=np.uint64))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    """64 bits of each word, as the words of a text are hashed."""
    out = np.zeros(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        code = np.array([_FOLD[min(ord(c), 65_535)] for c in word], dtype=np.uint64)
        out[i] = (code * _powers(len(word))[0][: len(word)]).sum(dtype=np.uint64)
    return _mixed(out)


_VOCABULARY = sorted(set().union(*_FUNCTION.values()))
_HASHES = word_hashes(_VOCABULARY)
_ORDER = np.argsort(_HASHES)
_SORTED = _HASHES[_ORDER]
#: Places of a function distribution: all function words, the particle kana, anything else.
_PLACES = len(_VOCABULARY) + len(_KANA) + 1
_ELSE = _PLACES - 1
_MEMBER = np.zeros((_PLACES, len(FUNCTION_WORDS)), dtype=bool)
for _l, _known in enumerate(_FUNCTION.values()):
    _MEMBER[[_VOCABULARY.index(w) for w in _known], _l] = True
_KANA_PLACE = np.full(65_536, _ELSE, dtype=np.int16)
_KANA_PLACE[[ord(c) for c in _KANA]] = len(_VOCABULARY) + np.arange(len(_KANA))

#: Names of the basic counts of a unit, in order.
PLAIN = (
    "log_chars", "log_lines", "lines_end", "line_chars", "line_spread", "log_words", "word_chars", "function", "function_best", "distinct", "twice",
    "ident", "digits", "symbols", "lower_start", "upper_start", "segment_words", "segment_spread", "sentence_words", "sentence_upper", "joined",
    "kana", "kanji", "kana_known", "bullet", "quoted", "who", "first_words", "vowels", "commas", "stops", "rare_bigrams", "tab_lines", "repeat_lines",
    "token_chars", "segment_chars", "cells", "cells_spread", "kana_steps", "longest_token", "dots",
)


@dataclass
class Measured:
    """What is known of the units of a batch, one row each."""

    plain: np.ndarray
    chars: np.ndarray
    lang: np.ndarray
    steps: np.ndarray
    #: Nonzero places of the function distributions: unit, place, share.
    function: tuple[np.ndarray, np.ndarray, np.ndarray]
    #: Words: unit and hash.
    words: tuple[np.ndarray, np.ndarray]

    def __len__(self) -> int:
        return len(self.plain)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; the last element must be false."""
    step = np.diff(flag.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal keys."""
    if not len(key):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


def measure(cut: list[tuple[str, list[str], int]]) -> Measured:
    """Measures units together: every count is one pass over the characters, words or lines of all of them."""
    n = len(cut)
    lines = [x for _, own, _ in cut for x in own]
    per_unit = np.fromiter((len(own) for _, own, _ in cut), dtype=np.int64, count=n)
    unit_of_line = np.repeat(np.arange(n), per_unit)
    lens = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    code = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.minimum(code, 65_535).astype(np.uint16)
    line_end = np.cumsum(lens + 1) - 1
    line_start = line_end - lens
    line_of = np.repeat(np.arange(len(lines), dtype=np.int32), lens + 1)
    unit_of = np.repeat(unit_of_line.astype(np.int32), lens + 1)

    total = lambda at, weight=None: np.bincount(at, weights=weight, minlength=n).astype(float)

    def moments(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(total(at), 1)
        mean = total(at, values) / count
        return mean, np.sqrt(np.maximum(total(at, values.astype(float) ** 2) / count - mean**2, 0))

    chars = np.bincount(unit_of.astype(np.int64) * N_CLASSES + _CLASS[code], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    length = np.maximum(total(unit_of), 1)

    # words and function words
    power, inverse = _powers(len(code) + 1)
    prefix = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(_FOLD[code].astype(np.uint64) * power[: len(code)], out=prefix[1:])
    start, end = _runs(_LETTER[code])
    size = end - start
    elided = (size <= 2) & ((code[end] == ord("'")) | (code[end] == ord("’")))
    hashed = _mixed((prefix[end + elided] - prefix[start]) * inverse[start])
    of_word = unit_of[start]
    place = np.minimum(np.searchsorted(_SORTED, hashed), len(_SORTED) - 1)
    place = np.where(_SORTED[place] == hashed, _ORDER[place], _ELSE)
    words = total(of_word)
    some = np.maximum(words, 1)
    letters = np.maximum(total(of_word, size), 1)
    met = np.array([total(of_word, _MEMBER[place, l]) for l in range(len(FUNCTION_WORDS))])
    lang, best = met.argmax(axis=0), met.max(axis=0) / some
    kana = chars[:, PARTICLE] + chars[:, HIRAGANA]
    japanese = kana / length > 0.05
    known = _MEMBER[place, lang[of_word]]
    lang = np.where(japanese, len(FUNCTION_WORDS), lang)

    step = np.full((n, 7), 0.25)
    pair = of_word[1:] == of_word[:-1]
    at, kind = of_word[1:][pair].astype(np.int64), (known[:-1] * 2 + known[1:])[pair]
    step[:, :4] += np.bincount(at * 4 + kind, minlength=4 * n).reshape(n, 4)
    first, run = _groups(of_word.astype(np.int64) * 2 + known)
    long = known[first] & (words[of_word[first]] > 1)
    step[:, 4:] += np.bincount(of_word[first][long].astype(np.int64) * 3 + np.digitize(run[long], (2, 4)), minlength=3 * n).reshape(n, 3)

    latin = ~japanese[of_word]
    hira = np.flatnonzero(((_CLASS[code] == PARTICLE) | (_CLASS[code] == HIRAGANA)) & japanese[unit_of])
    owner = np.r_[of_word[latin], unit_of[hira]].astype(np.int64)
    spot = np.r_[np.where(known, place, _ELSE)[latin], _KANA_PLACE[code[hira]]]
    table = np.bincount(owner * _PLACES + spot, minlength=n * _PLACES)
    filled = np.flatnonzero(table)
    owners = filled // _PLACES
    share = table[filled] / np.maximum(np.bincount(owner, minlength=n), 1)[owners]

    mask = np.uint64(2**44 - 1)

    def unlike(unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many different values each unit has, and how many it has once."""
        key = np.sort((unit.astype(np.uint64) << np.uint64(44)) | (h & mask))
        first, run = _groups(key)
        of = (key[first] >> np.uint64(44)).astype(np.int64)
        return total(of), total(of[run == 1])

    distinct, _ = unlike(of_word, hashed)
    _, once = unlike(of_word[1:][pair], _mixed(hashed[:-1] * np.uint64(3) + hashed[1:])[pair])
    twice = total(of_word[1:][pair], (hashed[1:] == hashed[:-1])[pair])

    # tokens between blanks, those that look like code
    blank = _BLANK[code]
    t_start, t_end = _runs(~blank)
    of_token = unit_of[t_start]
    wordy = _WORDY[code]
    before, after = np.r_[False, wordy[:-1]], np.r_[wordy[1:], False]
    following = np.r_[code[1:], np.uint16(10)]
    sign = np.r_[False, (_LOWER[code] | (_CLASS[code] == DIGIT))[:-1]] & (_CLASS[code] == CAPITAL)
    sign |= (code == ord("_")) & before & after
    sign |= (code == ord("/")) & before & (after | (following == ord(".")) | (following == ord("-")))
    sign |= (code == ord("(")) & before
    sign |= (code == ord(":")) & before & (following == ord("/"))
    signs = np.r_[0, np.cumsum(sign, dtype=np.int32)]
    ident = total(of_token, np.where(signs[t_end] > signs[t_start], t_end - t_start, 0))
    tokens = total(of_token)
    longest = np.zeros(n)
    first, _ = _groups(of_token)
    if len(first):
        longest[of_token[first]] = np.maximum.reduceat(t_end - t_start, first)

    # segments and sentences
    next_blank = np.r_[blank[1:], True]
    space = code == 32
    double = space & (np.r_[False, space[:-1]] | np.r_[space[1:], False])
    cut_here = _CUT[code] | double | (_CUT_STOP[code] & next_blank)
    s_start, s_end = _runs(~(blank | cut_here))
    first, run = _groups(np.cumsum(cut_here, dtype=np.int32)[s_start])
    of_segment = unit_of[s_start[first]]
    segment_words = moments(of_segment, run)
    span = s_end[np.r_[first[1:], len(s_start)] - 1] - s_start[first] if len(first) else np.zeros(0)
    segment_chars, _ = moments(of_segment, span)
    full = _FULL_STOP[code] & (next_blank | (following > 127))
    sentence = np.r_[0, np.cumsum(full, dtype=np.int32)][t_start].astype(np.int64)
    first, run = _groups(sentence + of_token.astype(np.int64) * (len(code) + 1))
    of_sentence = of_token[first]
    sentences = np.maximum(total(of_sentence), 1)
    sentence_words, _ = moments(of_sentence, run)
    sentence_upper = total(of_sentence, _UPPER[code[t_start[first]]]) / sentences

    # lines
    line_count = np.maximum(per_unit, 1)
    line_tokens = np.bincount(line_of[t_start], minlength=len(lines))
    filled_line = line_tokens > 0
    last = np.cumsum(line_tokens) - 1
    head = np.where(filled_line, t_start[np.clip(last - line_tokens + 1, 0, len(t_start) - 1)] if len(t_start) else 0, line_start)
    tail = code[np.where(filled_line, t_end[np.maximum(last, 0)] - 1 if len(t_end) else 0, line_end)]
    opening = code[head]
    mean_len, spread_len = moments(unit_of_line, lens)
    log_len, _ = moments(unit_of_line, np.log1p(lens))
    together = unit_of_line[1:] == unit_of_line[:-1]
    joined = together & ~_OPEN_END[tail[:-1]] & _LOWER[opening[1:]] & (head[1:] == line_start[1:])
    inside = np.arange(len(code)) > head[line_of]
    wide = double & ~np.r_[False, space[:-1]]
    cells = np.bincount(line_of[(_CELL[code] | wide) & inside], minlength=len(lines))
    triple = space & np.r_[False, space[:-1]] & np.r_[False, False, space[:-2]][: len(code)]
    tabbed = np.bincount(line_of[((code == 9) | triple) & inside], minlength=len(lines)) > 0
    line_hash = _mixed((prefix[line_end] - prefix[line_start]) * inverse[line_start])
    different, _ = unlike(unit_of_line, line_hash)
    steps_in = np.r_[False, ((_CLASS[code] == KANJI) | (_CLASS[code] == KATAKANA))[:-1]] & ((_CLASS[code] == HIRAGANA) | (_CLASS[code] == PARTICLE))
    cell_moments = moments(unit_of_line, cells)
    kinds = [k for k, _, _ in cut]
    began = lambda signs: np.array([k[:1] in signs and k != "" for k in kinds], dtype=float)

    plain = np.array([
        np.log1p([size for _, _, size in cut]), np.log(line_count), total(unit_of_line, _ENDING[tail]) / line_count, log_len, spread_len / (mean_len + 1),
        np.log1p(words), letters / some, total(of_word, place != _ELSE) / some, best, distinct / some, twice / some,
        ident / length, chars[:, DIGIT] / length, (chars[:, SYMBOL] + chars[:, PUNCTUATION] + chars[:, BOX] + chars[:, OTHER] + chars[:, WIDE]) / length,
        total(unit_of_line, _LOWER[opening]) / line_count, total(unit_of_line, _UPPER[opening]) / line_count,
        np.log1p(segment_words[0]), segment_words[1], np.log1p(sentence_words), sentence_upper, total(unit_of_line[1:], joined) / line_count,
        kana / length, chars[:, KANJI] / length, chars[:, PARTICLE] / np.maximum(kana, 1), began("-*+•‣▪·1[abc"), began("/>#;%"), np.array([k == "who:" for k in kinds], dtype=float),
        np.log1p(moments(unit_of_line, line_tokens)[0]), (chars[:, VOWEL] + chars[:, ACCENTED]) / letters, chars[:, COMMA] / length, sentences / some,
        once / np.maximum(words - 1, 1), total(unit_of_line, tabbed) / line_count, 1 - different / line_count,
        np.log1p(length / np.maximum(tokens, 1)), np.log1p(segment_chars), *cell_moments, total(unit_of, steps_in) / length, np.log1p(longest),
        total(unit_of, (code == 46) & (following == 46)) / np.maximum(words + kana, 1),
    ]).T.reshape(n, len(PLAIN))
    return Measured(plain, chars / length[:, None], lang, step / step.sum(axis=1, keepdims=True), (owners, filled % _PLACES, share), (of_word, hashed))


# ---- profiles ---------------------------------------------------------------------------------------------------------


def _point_jsd(p: np.ndarray) -> np.ndarray:
    """Divergence of a distribution that is all in one band from one that has the share ``p`` there."""
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = np.where(p > 0, p * np.log2(2 * p / (1 + p)), 0)
    return (np.log2(2 / (1 + p)) + shared + 1 - p) / 2


@contextlib.contextmanager
def one_thread() -> Iterator[None]:
    """Keeps the linear algebra library to one thread: for products as small as these more cost more than they give."""
    calls = []
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for prefix in ("scipy_openblas", "openblas"):
            for suffix in ("64_", ""):
                names = [f"{prefix}_{verb}_num_threads{suffix}" for verb in ("get", "set")]
                if all(hasattr(lib, n) for n in names):
                    calls.append([getattr(lib, n) for n in names])
    before = [get() for get, _ in calls]
    for _, set_ in calls:
        set_(1)
    try:
        yield
    finally:
        for (_, set_), n in zip(calls, before):
            set_(n)


class Profiles:
    """Structural profiles, several of each shape, and the relevance of each coordinate.

    A profile is a distribution over the bands (of equal frequency) of every
    coordinate. Its distance from a unit is the sum over coordinates of the
    Jensen-Shannon divergence from the band that the unit is in, times the
    coordinate's relevance. Profiles start as the averages of groups of units of
    one shape; then they and the relevances are moved down the slope of the
    cross entropy of the labels (learning vector quantisation with relevances).
    """

    BANDS, EACH, ROUNDS, STEPS, KEEP = 8, 8, 4, 80, 0.4

    def fit(self, texts: list[str], shapes: list[str]) -> Profiles:
        """Fits to the labelled texts and ``EXAMPLES``; labels that stand far off after a round are left out of the next."""
        with one_thread():
            return self._fit([*(t for _, t in EXAMPLES), *texts], [*(s for s, _ in EXAMPLES), *shapes])

    def _fit(self, texts: list[str], shapes: list[str]) -> Profiles:
        cuts = [units(t) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        every = [u for c in cuts for u in c]
        w = np.minimum(np.array([u[2] for u in every], dtype=float), 2_000)
        weight = w / np.bincount(doc, weights=w, minlength=len(texts))[doc]
        shape = np.array([SHAPES.index(s) for s in shapes])[doc]
        measured = measure(every)
        keep = np.ones(len(every), dtype=bool)
        for turn in range(self.ROUNDS):
            self._references(measured, shape, w, keep)
            x = self._coordinates(measured)
            self.cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, self.BANDS + 1)[1:-1])) for c in range(x.shape[1])]
            odds = self._learn(self._bands(x), measured.lang, shape, weight, keep, turn, self.PULL / len(texts))
            keep = (odds[np.arange(len(shape)), shape] > self.KEEP) | (doc < len(EXAMPLES))
        return self

    def _references(self, m: Measured, shape: np.ndarray, w: np.ndarray, keep: np.ndarray) -> None:
        """Distributions of the prose of each language, character classes of each shape, words that prose has in common."""

        def mean(rows: np.ndarray, on: np.ndarray) -> np.ndarray:
            return np.average(rows[on], axis=0, weights=w[on]) if on.any() else rows.mean(axis=0)

        self.chars = np.array([mean(m.chars, keep & (shape == s)) for s in range(len(SHAPES))])
        prose = keep & (shape == 0)
        self.steps = np.array([mean(m.steps, prose & (m.lang == l)) for l in range(len(LANGUAGES))])
        self.lang_chars = np.array([mean(m.chars, prose & (m.lang == l)) for l in range(len(LANGUAGES))])
        self.function = np.zeros((len(LANGUAGES), _PLACES))
        owner, place, share = m.function
        for l in range(len(LANGUAGES)):
            on = (prose & (m.lang == l))[owner]
            self.function[l] = np.bincount(place[on], weights=(share * w[owner])[on], minlength=_PLACES) + 1e-9
        self.function /= self.function.sum(axis=1, keepdims=True)
        key = np.unique(np.array([m.words[0][prose[m.words[0]]].astype(np.uint64), m.words[1][prose[m.words[0]]]]), axis=1)[1]
        seen, n = np.unique(key, return_counts=True)
        self.common = seen[n >= max(2, 0.002 * prose.sum())]

    def divergences(self, m: Measured) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of function words, of steps and of character classes, from the prose of the unit's language."""
        owner, place, p = m.function
        q = self.function[m.lang[owner], place]
        mid = (p + q) / 2
        held = np.bincount(owner, weights=p * np.log2(p / mid) + q * np.log2(q / mid) - q, minlength=len(m))
        return np.clip((held + 1) / 2, 0, 1), jsds(m.steps, self.steps[m.lang]), jsds(m.chars, self.lang_chars[m.lang])

    def common_words(self, m: Measured) -> tuple[np.ndarray, np.ndarray]:
        """Words of each unit that prose has in common, and all its words."""
        of, h = m.words
        known = np.zeros(len(h), dtype=bool)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            known = self.common[at] == h
        return np.bincount(of, weights=known, minlength=len(m)), np.bincount(of, minlength=len(m))

    def _coordinates(self, m: Measured) -> np.ndarray:
        far = [jsds(m.chars, c) for c in self.chars]
        common, n = self.common_words(m)
        return np.column_stack([m.plain, *far, *self.divergences(m), np.where(n > 0, common / np.maximum(n, 1), -1.0)])

    def _bands(self, x: np.ndarray) -> np.ndarray:
        """Number of the band of every coordinate, counted through all coordinates."""
        return np.column_stack([np.searchsorted(cuts, x[:, c], side="right") + c * self.BANDS for c, cuts in enumerate(self.cuts)])

    def _averages(self, z: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Smoothed shares of the bands among the units ``own``."""
        out = weight[own] @ z[own] + 0.05
        blocks = out.reshape(-1, self.BANDS) * self._real
        return (blocks / blocks.sum(axis=1, keepdims=True)).ravel()

    def _learn(self, bands: np.ndarray, lang: np.ndarray, shape: np.ndarray, weight: np.ndarray, keep: np.ndarray, turn: int, pull: float) -> np.ndarray:
        coordinates = bands.shape[1]
        self._real = np.array([[b <= len(c) for b in range(self.BANDS)] for c in self.cuts])
        z = np.zeros((len(bands), coordinates * self.BANDS), dtype=np.float32)
        z[np.arange(len(bands))[:, None], bands] = 1
        rng = np.random.default_rng(turn)
        starts, self.shape_of = [], []
        for s in range(len(SHAPES)):
            every = keep & (shape == s)
            # prose begins with groups of its own for every language
            for part in [every & (lang == l) for l in np.unique(lang[every])] if s == 0 else [every]:
                own = np.flatnonzero(part)
                n = min(max(2, round(self.EACH * len(own) / every.sum())), 1 + len(own) // self.LEAST)
                groups = rng.integers(0, n, len(own))
                for _ in range(6):  # groups of like units, each nearest to its own average
                    means = np.array([self._averages(z, weight, own[groups == g]) for g in range(n) if (groups == g).any()])
                    groups = (z[own] @ _point_jsd(means).T.astype(np.float32)).argmin(axis=1)
                starts += list(means)
                self.shape_of += [s] * len(means)
        self.shape_of = np.array(self.shape_of)
        logit = np.log(np.maximum(np.array(starts), 1e-4))
        scale = np.zeros(coordinates)
        member = np.eye(len(SHAPES))[self.shape_of]
        z_kept, y, w = z[keep], np.eye(len(SHAPES))[shape[keep]], weight[keep] / weight[keep].sum()
        state = [np.zeros_like(logit), np.zeros_like(logit), np.zeros_like(scale), np.zeros_like(scale)]
        base_logit, steps = logit.copy(), self.STEPS * (2 if turn == self.ROUNDS - 1 else 1)
        for t in range(1, steps + 1):
            p, relevance, cost = self._table(logit, scale)
            near = np.exp(-self._shifted(z_kept @ cost.T.astype(np.float32)))
            odds = near / near.sum(axis=1, keepdims=True)
            within = near * member[:, :].T[y.argmax(axis=1)]
            within /= np.maximum(within.sum(axis=1, keepdims=True), 1e-30)
            slope = ((within - odds) * w[:, None]).T.astype(np.float32) @ z_kept  # of the loss by each entry of the cost table
            blocks = slope.reshape(len(logit), coordinates, self.BANDS)
            by_p = blocks * relevance[None, :, None] * 0.5 * np.log2(np.maximum(p, 1e-12) / (1 + p))
            by_logit = (p * (by_p - (by_p * p).sum(axis=2, keepdims=True))).reshape(logit.shape) + pull * (logit - base_logit)
            by_scale = (blocks * _point_jsd(p)).sum(axis=(0, 2)) * relevance + pull * scale
            rate = 0.15 * (1 - 0.9 * t / steps)
            for value, slope_of, i in ((logit, by_logit, 0), (scale, by_scale, 2)):
                state[i] = 0.9 * state[i] + 0.1 * slope_of
                state[i + 1] = 0.99 * state[i + 1] + 0.01 * slope_of**2
                value -= rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 1] / (1 - 0.99**t)) + 1e-7)
        _, _, self.cost = self._table(logit, scale)
        near = np.exp(-self._shifted(z @ self.cost.T.astype(np.float32)))
        return near @ member / near.sum(axis=1, keepdims=True)

    #: Pull of profiles and relevances towards where they started, in documents; least units of a group.
    PULL, LEAST = 4.0, 12
    #: Relevance that every coordinate starts with.
    START = 3.0

    def _table(self, logit: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands' shares, relevances, and the distance that each band adds to each profile."""
        blocks = logit.reshape(len(logit), -1, self.BANDS)
        e = np.exp(blocks - blocks.max(axis=2, keepdims=True)) * self._real
        p = e / e.sum(axis=2, keepdims=True)
        relevance = self.START * np.exp(scale)
        return p, relevance, (_point_jsd(p) * relevance[None, :, None]).reshape(logit.shape)

    @staticmethod
    def _shifted(distance: np.ndarray) -> np.ndarray:
        return distance - distance.min(axis=1, keepdims=True)

    def nearest(self, m: Measured) -> np.ndarray:
        """Shape (its place in ``SHAPES``) of the profile nearest to each unit."""
        if not len(m):
            return np.zeros(0, dtype=int)
        bands = self._bands(self._coordinates(m))
        distance = np.zeros((len(m), len(self.shape_of)))
        for c in range(bands.shape[1]):
            distance += self.cost.T[bands[:, c]]
        return self.shape_of[distance.argmin(axis=1)]


def fit_profiles(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_chars: int = 20_000) -> Profiles:
    """Profiles from at most ``most`` labelled documents of at most ``most_chars`` characters.

    ``labels``: ``doc_id``, ``shape``, one row for each opinion; the commonest
    counts, ties to the first by name. Other shapes than the five, and null
    ids, are left out. The sample is that of the lowest id hashes.
    """
    votes = labels.filter(F.col("shape").isin(*SHAPES) & F.col("doc_id").isNotNull()).groupBy("doc_id", "shape").count()
    chosen = votes.groupBy("doc_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "shape"))["shape"].alias("shape"))
    chosen = chosen.orderBy(F.xxhash64("doc_id")).limit(most)  # a bound, hence the broadcast
    texts = documents.select("doc_id", "text").filter(F.length("text") <= most_chars).join(F.broadcast(chosen), "doc_id")
    rows = sorted(texts.select("doc_id", "shape", "text").limit(most).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return Profiles().fit([r["text"] or "" for r in rows], [r["shape"] for r in rows])


RESULT = "doc_id bigint, lang string, n_units int, prose_share double, shape string, common_share double, function_divergence double, char_divergence double"


def profile_documents(documents: DataFrame, profiles: Profiles, batch_chars: int = 500_000) -> DataFrame:
    """Nearest structural profile of every document.

    ``prose_share`` is the share of characters (line ends and outer blanks do
    not count) in units of prose; ``shape`` the shape that holds most of them,
    'blank' for null and blank texts, whose share is 0. ``lang`` is the language
    that holds most of them, by function words, 'ja' where kana are met. The
    divergences are those of the largest unit from the prose of its language.
    Every row counts, whatever its id; whole texts are read. One Arrow pass, no
    shuffle; units of some ``batch_chars`` characters are measured at a time.
    """

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, cuts, held = [], [], 0
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids.append(doc_id)
                cuts.append(units(text) if isinstance(text, str) else [])
                held += len(text) if isinstance(text, str) else 0
                if held >= batch_chars:
                    yield describe_batch(profiles, ids, cuts)
                    ids, cuts, held = [], [], 0
            if ids:
                yield describe_batch(profiles, ids, cuts)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(describe, RESULT)


def _parts(cut: list[tuple[str, list[str], int]]) -> Iterator[list[tuple[str, list[str], int]]]:
    """Units in turn, some ``UNIT_CHARS`` characters at a time."""
    part: list[tuple[str, list[str], int]] = []
    held = 0
    for unit in cut:
        if part and held + unit[2] > UNIT_CHARS:
            yield part
            part, held = [], 0
        part.append(unit)
        held += unit[2]
    yield part


def _judged(profiles: Profiles, cut: list[tuple[str, list[str], int]]) -> tuple[np.ndarray, ...]:
    """Of each unit the shape, the language, the divergences of function words and characters, and its common and all words."""
    m = measure(cut)
    function, _, chars = profiles.divergences(m)
    return profiles.nearest(m), m.lang, function, chars, *profiles.common_words(m)


def describe_batch(profiles: Profiles, ids: list, cuts: list[list]) -> pd.DataFrame:
    """The rows of ``RESULT`` for documents that are cut into units."""
    n = len(ids)
    counts = np.array([len(c) for c in cuts])
    out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "lang": "", "n_units": counts.astype(np.int32), "prose_share": 0.0, "shape": "blank", "common_share": 0.0, "function_divergence": np.nan, "char_divergence": np.nan})
    every = [u for cut in cuts for u in cut]
    if not every:
        return out
    found = [_judged(profiles, part) for part in _parts(every)]
    shape, lang, function, chars, known, of_all = (np.concatenate(x) for x in zip(*found))
    doc = np.repeat(np.arange(n), counts)
    size = np.array([u[2] for u in every], dtype=float)
    held = np.bincount(doc * len(SHAPES) + shape, weights=size, minlength=n * len(SHAPES)).reshape(n, -1)
    spoken = np.bincount(doc * len(LANGUAGES) + lang, weights=size, minlength=n * len(LANGUAGES)).reshape(n, -1)
    common, words = (np.bincount(doc, weights=x, minlength=n) for x in (known, of_all))
    order = np.lexsort((-np.arange(len(doc)), size, doc))  # the first largest unit of a document comes last
    largest = order[np.cumsum(counts)[counts > 0] - 1]
    some = counts > 0
    out["prose_share"] = held[:, 0] / np.maximum(held.sum(axis=1), 1)
    out.loc[some, "shape"] = np.array(SHAPES, dtype=object)[held.argmax(axis=1)][some]
    out.loc[some, "lang"] = np.array(LANGUAGES, dtype=object)[spoken.argmax(axis=1)][some]
    out["common_share"] = common / np.maximum(words, 1)
    out.loc[some, "function_divergence"] = function[largest]
    out.loc[some, "char_divergence"] = chars[largest]
    return out


def basic_statistics(documents: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Counts of every document inside the JVM; null texts count as empty.

    Words are runs without white space, symbols what is neither letter, digit
    nor white space, lines those that are not blank. Shares of nothing are 0.

    ``common_word_share`` is the best share of function words of the
    ``languages``: an elided article (``l'``) counts as the word it begins, and
    Japanese is the share of particle kana among letters. Full-width marks end
    a line, too. With English alone only plain words and ASCII marks count.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")
    n_words, n_lines = F.size("__w"), F.size("__l")
    several = languages != ("en",)
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}]+|[^\p{L}]+$", "")
    head = lambda w: F.regexp_replace(F.regexp_extract(w, "^([^'’]+['’])", 1), "’", "'")

    def common(lang: str) -> Column:
        """Share of a language's function words in ``__b``, the words without outer marks."""
        if lang == "ja":
            count = lambda but: F.length(F.regexp_replace("__t", but, ""))
            return F.when(F.col("__t").rlike("[ぁ-ゞ]"), F.try_divide(count(f"[^{_KANA}]"), count(r"[^\p{L}]")))
        known = sorted(_FUNCTION[lang])
        met = lambda w: w.isin(known) | head(w).isin(known) if several else w.isin(known)
        return F.try_divide(F.size(F.filter("__b", met)), n_words)

    shares = [F.coalesce(common(lang), F.lit(0.0)) for lang in languages]
    ended = F.filter("__l", lambda x: x.rlike(r"[.!?:;,。！？：；，、．]\s*$" if several else r"[.!?:;,]\s*$"))
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)
    return documents.select("doc_id", text.alias("__t"), words.alias("__w"), lines.alias("__l")).withColumn("__b", F.transform("__w", bare)).select(
        "doc_id",
        n_words.cast("bigint").alias("n_words"),
        n_lines.cast("bigint").alias("n_lines"),
        share(F.length(F.array_join("__w", "")), n_words).alias("mean_word_chars"),
        share(F.length(F.regexp_replace("__t", r"[\p{L}\p{N}\s]", "")), F.length("__t")).alias("symbol_share"),
        share(F.size(ended), n_lines).alias("ended_line_share"),
        F.round(F.greatest(*shares) if several else shares[0], 6).alias("common_word_share"),
    )
