"""Text that was read in the wrong character encoding: find it and give back the original.

A multinomial classifier over hashed byte bigrams predicts, for each run of non-ASCII characters with its two neighbours,
the chain of wrong readings that produced it: UTF-8 read as a single-byte encoding once or more, UTF-8 read as an East
Asian encoding, or one single-byte encoding read as another. The chain is then inverted. Sequences of UTF-8 must decode
strictly; a text counts as complete only where every garbled run decoded as a whole. One single-byte reading as another
always decodes, so it needs evidence besides: whole words that become words of one script, or several letters of the
wrong case or script inside words. Training garbles clean text with every chain: a bounded sample of the collection's own
runs and generated words over many alphabets.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.sources.tables import of_last_delivery

#: Single-byte encodings in which UTF-8 is commonly misread: fixed values, likeliest first.
CODECS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15", "iso8859-2", "cp1254", "cp1253", "koi8-r", "cp866", "mac_latin2")
#: What makes an encoding less likely than the common ones, in log-probability.
RARITY = {"iso8859-15": 3.0, "iso8859-2": 2.0, "cp1254": 3.0, "cp1253": 2.0, "koi8-r": 2.0, "cp866": 3.0, "mac_latin2": 3.0, "cp850": 1.0}
#: Chains of one wrong reading and of two; what a case change does to garbled text counts as part of the chain.
CHAINS = tuple((c,) for c in CODECS) + tuple((a, b) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437")) + (("cp1252", "cp1252", "cp1252"),)
CASES = ("", "lower", "upper")
#: East Asian encodings in which UTF-8 is misread: fixed values.
MULTI = ("cp932", "gbk")
#: Single-byte encodings (written, read) of which one is misread as the other: fixed values.
CYRILLIC = (("cp1251", "cp1252"), ("koi8-r", "cp1252"))
LATIN = (("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp850", "cp1252"))
READINGS = {f"{written}/{read}": (written, read) for written, read in CYRILLIC + LATIN}
LABELS = ("clean", "lost", *(">".join(c) + (f">{k}" if k else "") for c in CHAINS for k in CASES), *MULTI, *READINGS)
#: Readings whose common signs of three bytes are also recognised where the last byte is gone.
CUT_SHORT = ("cp1252", "latin-1", "cp1250", "cp1251")
BUCKETS = 1 << 13
#: A chain is tried if its log-probability is at most this far below that of clean text.
MARGIN = 12.0
RUN = re.compile(r"[^\x00-\x7f]+")
EAST_ASIAN = re.compile(r"[\u2e80-\u9fff\uac00-\ud7a3\uff01-\uffee]")
PIECE = re.compile(r"[^\x00-\x7f\u2e80-\u9fff\uac00-\ud7a3\uff01-\uffee]+")
#: Alphabets of the generated training words: fixed values, first and last code point.
ALPHABETS = ((0xC0, 0xFF), (0xE0, 0xFC), (0xA1, 0xBF), (0x2010, 0x2026), (0x20AC, 0x20AC), (0x100, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x3041, 0x3096), (0x4E00, 0x9FA0), (0x2190, 0x2265), (0x2500, 0x2606))


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[dict[int, str], dict[str, int]]:
    """Characters of the bytes 128 to 255 and back; bytes without one stay control characters, as browsers do."""
    chars = {}
    for b in range(128, 256):
        try:
            chars[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            chars[b] = chr(b)
    back: dict[str, int] = {}
    for b, c in chars.items():
        back.setdefault(c, b)
    for b in range(128, 160):  # C1 controls often pass through unchanged
        back.setdefault(chr(b), b)
    return chars, back


def misread(text: str, written: str, read: str) -> str | None:
    """Bytes of one single-byte encoding read in another; None where a character has no byte or becomes a control."""
    back, chars = _table(written)[1], _table(read)[0]
    if any(ord(c) > 127 and c not in back for c in text):
        return None
    out = "".join(c if ord(c) < 128 else chars[back[c]] for c in text)
    return None if any(0x80 <= ord(c) < 0xA0 for c in out) else out


def undo_multi(run: str, codec: str) -> str | None:
    """The UTF-8 text that an East Asian reading shows as the whole run; None where its bytes are none."""
    try:
        text = run.encode(codec).decode("utf-8")
    except UnicodeError:
        return None
    return text if "\ufffd" in text or (all(map(_plausible, text)) and _one_script(text)) else None


def cut_short(run: str, codec: str) -> bool:
    """Whether a run is UTF-8 but for its last sequence, which has two bytes or more and lacks its end."""
    back = _table(codec)[1]
    if any(c not in back for c in run):
        return False
    data = bytes(back[c] for c in run)
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as fault:
        return fault.reason == "unexpected end of data" and len(data) - fault.start > 1
    return False


def garble(text: str, chain: tuple[str, ...], case: str = "") -> str:
    """text as the chain of wrong readings shows it."""
    for codec in chain:
        chars = _table(codec)[0]
        text = "".join(chr(b) if b < 128 else chars[b] for b in text.encode("utf-8"))
    return text.lower() if case == "lower" else text.upper() if case == "upper" else text


def _utf8_length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def _undo(text: str, codec: str, case: str, accept: Callable[[str, str, str], bool] | None = None) -> tuple[str, int] | None:
    """One reading undone: valid UTF-8 sequences are decoded, other characters stay; None unless one was decoded.

    With a case change, each character may stand for the byte of either of its cases. accept: whether a decoded
    character counts, given the garbled sequence and the character before it; else the plausible ones do.
    """
    back = _table(codec)[1]

    def options(c: str) -> list[int]:
        forms = [c] if not case else [c, c.upper() if case == "lower" else c.lower()]
        return list(dict.fromkeys(back[f] for f in forms if f in back))

    out, at, decoded = [], 0, 0
    while at < len(text):
        for lead in options(text[at]):
            size = _utf8_length(lead)
            tail = [[b for b in options(c) if 0x80 <= b <= 0xBF] for c in text[at + 1 : at + size]]
            if not size or len(tail) != size - 1 or not all(tail):
                continue
            try:
                char = bytes([lead, *(t[0] for t in tail)]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if accept(char, text[at : at + size], text[at - 1 : at] if at else "") if accept else _plausible(char):
                out.append(char)
                at += size
                decoded += 1
                break
        else:
            out.append(text[at])
            at += 1
    return ("".join(out), decoded) if decoded else None


#: Code points of the scripts and signs that single garbled characters are taken for; other scripts need two in a run.
USUAL = ((0xA0, 0x24F), (0x370, 0x3FF), (0x400, 0x45F), (0x2010, 0x2052), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x27BF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFFEE), (0x1F300, 0x1FAFF))


def _plausible(char: str) -> bool:
    """Whether text holds such a character: assigned, not private, no phonetic sign."""
    return unicodedata.category(char) not in ("Cn", "Co", "Cs") and not 0x250 <= ord(char) <= 0x2AF and not 0x300 <= ord(char) <= 0x36F


def _one_script(text: str) -> bool:
    """Whether all letters are of one script; wrong chains give mixtures."""
    return len({0 if ord(c) < 0x370 else 1 if ord(c) < 0x400 else 2 if ord(c) < 0x530 else 3 if ord(c) < 0x2E80 else 4 for c in text if c.isalpha()}) < 2


def _usual(char: str) -> bool:
    return any(a <= ord(char) <= b for a, b in USUAL)


def undo(run: str, chain: tuple[str, ...], case: str = "") -> str | None:
    """The original of a garbled run, None where the chain does not fit it.

    Characters of a run that no valid sequence covers must be what clean text holds: no control character may remain.
    Where the case changed, sequences must cover all of the run.
    """
    if chain[0] in MULTI:
        return undo_multi(run, chain[0])
    text = run
    for step, codec in enumerate(reversed(chain)):
        result = _undo(text, codec, case if step == 0 else "")
        if result is None or (case and step == 0 and result[1] != len(result[0])):
            return None
        text = result[0]
    if any(0x80 <= ord(c) < 0xA0 for c in text) or not _one_script(text) or (result[1] < 2 and not all(map(_usual, text))):
        return None
    return text.lower() if case == "lower" else text.upper() if case == "upper" else text


def garbled_beyond_restoring(before: str, run: str, chain: tuple[str, ...], case: str, above: float) -> bool:
    """Whether a run that undo() gives up holds a garbled sequence all the same: an invisible sign, a ligature, a
    combining accent, a single letter of a rare script, a mixture of scripts.

    above: by how much the chain is likelier than clean text. Letters of one script may be a word, so a sequence must hold
    another sign or script; a short one, or one whose case changed, must also be likelier than clean text. A combining accent needs
    a letter before it and, where clean text is likelier, a capital after a small letter or a control character.
    """

    def accept(char: str, source: str, previous: str) -> bool:
        previous, code, word = previous or before, ord(char), source.isalpha() and _one_script(source)
        if unicodedata.category(char) in ("Cn", "Co", "Cs") or 0x250 <= code <= 0x2AF:
            return False
        if 0x300 <= code <= 0x36F:
            odd = (previous.islower() and source[0].isupper()) or any(0x80 <= ord(c) < 0xA0 for c in source)
            return previous.isalpha() and (odd or (above > 0 and not word))
        return not word and (above > 0 or (not case and len(source) > 2))

    text = run
    for step, codec in enumerate(reversed(chain)):
        result = _undo(text, codec, case if step == 0 else "", accept if step == len(chain) - 1 else None)
        if result is None or (case and step == 0 and result[1] != len(result[0])):
            return False
        text = result[0]
    return True


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def pieces(text: str) -> list[tuple[int, int, str, str]]:
    """The runs with the characters around them; those with East Asian signs whole where they are UTF-8 misread as such
    an encoding, else their parts without these signs, which no other wrong reading gives."""
    out = []
    for run in RUN.finditer(text):
        asian = EAST_ASIAN.search(run[0]) and any(undo_multi(run[0], c) is not None for c in MULTI)
        for m in [run] if asian or not EAST_ASIAN.search(run[0]) else PIECE.finditer(text, *run.span()):
            around = (text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1])
            out.append((*m.span(), *("" if RUN.match(c) else c for c in around)))
    return out


_ACCENTED = re.compile(r"[\u00c0-\u00ff]{4}")
_WORDS = re.compile(r"[A-Za-z\u00c0-\u024f\u0080-\u00bf]*[\u00c0-\u00ff]+[A-Za-z\u00c0-\u024f]*")
#: Typographic signs that stand between letters in correct text: fixed values.
_BETWEEN = frozenset("\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2026\u2022\u2122\u00ae\u00a9\u00b0\u00b4\u00b7\u00ad")


def cyrillic_words(text: str, written: str, read: str) -> list[tuple[int, int, str]]:
    """Words of accented Latin letters, and no other, that become Russian words: (start, end, original).

    One of them must have six letters, or two four; then shorter ones count too.
    """
    out = []
    for m in _WORDS.finditer(text):
        original = misread(m[0], read, written)
        if original is None or not all("\u0410" <= c <= "\u044f" or c in "\u0401\u0451" for c in original):
            continue
        vowels = sum(c in "\u0430\u0435\u0451\u0438\u043e\u0443\u044b\u044d\u044e\u044f" for c in original.lower())
        if vowels and (vowels < len(original) or len(original) < 3) and (original.islower() or original.isupper() or original.istitle()):
            out.append((*m.span(), original))
    longest = sorted((len(original) for _, _, original in out), reverse=True)
    return out if longest and (longest[0] > 5 or longest[1:2] > [3]) else []


def odd_letters(text: str) -> list[tuple[int, int, str]]:
    """Runs within words that start with a capital, another script's letter or, before a small letter, a sign: (start, end, run)."""
    return [
        (a, b, text[a:b]) for a, b, before, after in pieces(text)
        if before.islower() and text[a] not in _BETWEEN and not (text[a].islower() and ord(text[a]) < 0x370) and (text[a].isalpha() or after.islower())
    ]


def latin_letters(odd: list[tuple[int, int, str]], written: str, read: str) -> list[tuple[int, int, str]]:
    """The odd letters that become small Latin ones, if they are two at least: (start, end, original)."""
    out = []
    for start, end, run in odd:
        original = misread(run, read, written)
        if original is not None and all("\u00df" <= c <= "\u00ff" and c.isalpha() for c in original):
            out.append((start, end, original))
    return out if len(out) > 1 else []


def lost_blanks(text: str) -> list[tuple[int, int, str]]:
    """Letters whose second byte became a blank: a with grave accent, and the no-break space itself."""
    out = []
    for m in re.finditer("[\u00c3\u00c2] (?P<more> ?)", text):
        before = text[m.start() - 1 : m.start()]
        word = re.search(r"\w*$", text[max(0, m.start() - 40) : m.start()])[0]
        single = not before or before.isspace() or before in "(\"'"
        grave = m[0][0] == "\u00c3"
        if (word.isalpha() and word[1:].islower() and before.islower()) or (len(word) == 1 and word.islower()) or (single and (m["more"] or text[m.end() : m.end() + 1].islower() or not grave)) or (not grave and before and not before.isalpha()):
            out.append((m.start(), m.end(), ("\u00e0 " if grave else " ")))
    return out


def _around(text: str, start: int, end: int) -> str:
    return text[max(0, start - 1) : end + 1]


def _bigrams(span: str) -> np.ndarray:
    data = np.frombuffer(span.encode("utf-8", "replace"), np.uint8).astype(np.int64)
    return (data[:-1] * 257 + data[1:] * 31) % BUCKETS


@dataclass(frozen=True)
class ChainModel:
    """Log-probabilities of the bigram buckets for each label, and of the labels."""

    weights: np.ndarray
    priors: np.ndarray

    def ranked(self, span: str) -> list[tuple[str, float]]:
        scores = self.priors + self.weights[:, _bigrams(span)].sum(axis=1)
        order = np.argsort(-scores, kind="stable")
        return [(LABELS[i], float(scores[i])) for i in order]


def generated_words(count: int, seed: int) -> list[str]:
    """Words with letters of one alphabet each, some among ASCII letters."""
    rng = random.Random(seed)
    words = []
    for i in range(count):
        low, high = ALPHABETS[i % len(ALPHABETS)]
        special = [chr(rng.randint(low, high)) for _ in range(rng.choice((1, 1, 1, 2, 5)))]
        plain = [rng.choice("abcdefghijklmnopqrstuvwxyzAEIOST 0123") for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(plain))
        words.append("a " + "".join(plain[:at] + special + plain[at:]) + " b")
    return [w for w in words if all(_plausible(c) for c in w)]


def train(samples: list[str], words: int = 1200, seed: int = 7) -> ChainModel:
    """A model from clean texts (those that hold a sequence some chain inverts are set aside) and generated words."""
    clean = [t for t in samples if "�" not in t and not any(undo(t[a:b], (c,)) for a, b in spans(t) for c in CODECS)]
    texts = list(dict.fromkeys(_around(t, a, b) for t in clean for a, b in spans(t))) + generated_words(words, seed)
    counts = np.full((len(LABELS), BUCKETS), 0.05)

    def learn(label: int, text: str) -> None:
        for a, b in spans(text):
            np.add.at(counts[label], _bigrams(_around(text, a, b)), 1.0)

    for text in texts:
        learn(0, text)
        learn(1, RUN.sub("�", text))
        for codec in MULTI:
            learn(LABELS.index(codec), text.encode("utf-8").decode(codec, "ignore"))
        for name, (written, read) in READINGS.items():
            learn(LABELS.index(name), misread(text, written, read) or "")
        label = 2
        for chain in CHAINS:
            base = garble(text, chain)
            for case in CASES:
                learn(label, base.lower() if case == "lower" else base.upper() if case == "upper" else base)
                label += 1
    chains = (-1.0 - len(c) / 2 - bool(k) - RARITY.get(c[-1], 0.0) for c in CHAINS for k in CASES)
    priors = np.array([0.0, -1.0, *chains, *(-3.0 for _ in (*MULTI, *READINGS))])
    return ChainModel(np.log(counts / counts.sum(axis=1, keepdims=True)), priors)


class Repairer:
    """Applies a model to texts; results of recent spans are kept."""

    def __init__(self, model: ChainModel) -> None:
        self.model = model
        self.chains = {">".join(c) + (f">{k}" if k else ""): (c, k) for c in CHAINS for k in CASES} | {c: ((c,), "") for c in MULTI}
        self.span = lru_cache(maxsize=50_000)(self._span)

    def _span(self, before: str, run: str, after: str) -> list[tuple[float, str, str | None]]:
        """The chains that a run verifies, best first, with score and original (None: not restored); empty for clean text.

        A capital in the middle of a lower-case word counts against a chain. Where none gives the original, the likeliest
        that finds a garbled sequence is the only one.
        """
        if "�" in run:
            return [(0.0, "lost", None)]
        ranked = self.model.ranked(before + run + after)
        clean = next(s for label, s in ranked if label == "clean")
        fitting = []
        for label, score in ranked:
            if score < clean - MARGIN:
                break
            if label not in self.chains:
                continue
            chain, case = self.chains[label]
            # A changed case is assumed only where the chain alone does not fit, or in shouted text.
            if case and undo(run, chain) is not None and not (case == "upper" and before.isupper()):
                continue
            if (text := undo(run, chain, case)) is not None:
                if label in MULTI and not self._reads_on(before, run, after, text):
                    continue
                if "\ufffd" in text:
                    fitting.append((score, label, None))
                    continue
                odd = (before.islower() and text[0].isupper()) or (after.islower() and text[-1].isupper() and before.isalpha())
                fitting.append((score - 6.0 * odd, label, text))
        short = next((s for label, s in ranked if label in CUT_SHORT and s >= clean - MARGIN and cut_short(run, label)), None)
        if short is not None and short > max((f[0] for f in fitting), default=short - 1):
            return [(short, "cut short", None)]
        if not fitting:
            for label, score in ranked:
                if score < clean - MARGIN:
                    break
                if label in self.chains and label not in MULTI and garbled_beyond_restoring(before, run, *self.chains[label], score - clean):
                    return [(score, label, None)]
        return sorted(fitting, key=lambda f: -f[0])

    @staticmethod
    def _reads_on(before: str, run: str, after: str, text: str) -> bool:
        """Whether an East Asian run may be taken for other text: three signs or more for words of such a script or lost
        characters; for Latin letters a neighbour of the same word."""
        if "\ufffd" in text or any(ord(c) >= 0x370 for c in text):
            return len(run) > 2
        return (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha()) or len(text) > 2

    def other_readings(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """(label, replacements) of one single-byte encoding read as another, or of blanks in the place of bytes.

        Cyrillic must be as likely as clean text but for the margin, by the classifier; of several chains the likeliest
        counts, by the number of its words first.
        """
        best: tuple[int, float, str, list] = (0, 0.0, "", [])
        accented, odd = _ACCENTED.search(text), odd_letters(text)
        for label, (written, read) in READINGS.items():
            if (written, read) in CYRILLIC:
                found = cyrillic_words(text, written, read) if accented else []
            else:
                found = latin_letters(odd, written, read) if len(odd) > 1 else []
            if not found:
                continue
            score, clean = 0.0, 0.0
            for start, end, _ in found:
                ranked = dict(self.model.ranked(_around(text, start, end)))
                score, clean = score + ranked[label], clean + ranked["clean"]
            if score >= clean - MARGIN * len(found) and (len(found), score) > best[:2] or not best[2] and score >= clean - MARGIN * len(found):
                best = (len(found), score, label, found)
        if best[2]:
            return best[2], best[3]
        blanks = lost_blanks(text) if "\u00c3 " in text or "\u00c2 " in text else []
        return ("cp1252", blanks) if blanks else ("", [])

    def repair(self, text: str) -> tuple[list[str], str, bool]:
        """(chains found, the text with originals put back, whether all were restored).

        Runs of one record mostly share a chain: the one that fits most of them, of these the likeliest, goes first.
        """
        fits = [(a, b, f) for a, b, before, after in pieces(text) if (f := self.span(before, text[a:b], after))]
        total: dict[str, tuple[int, float]] = {}
        for _, _, fitting in fits:
            for score, label, original in fitting:
                if original is None and label != "lost":
                    continue
                count, summed = total.get(label, (0, 0.0))
                total[label] = (count + 1, summed + score)
        shared = max(total, key=lambda n: total[n], default="")
        found, out, last, whole = [], [], 0, True
        for start, end, fitting in fits:
            _, chain, original = next((f for f in fitting if f[1] == shared), fitting[0])
            found.append(chain)
            if original is None:
                whole = False
                continue
            out += [text[last:start], original]
            last = end
        restored = "".join([*out, text[last:]])
        label, others = self.other_readings(restored) if not restored.isascii() else ("", [])
        for start, end, original in reversed(others):
            restored = restored[:start] + original + restored[end:]
        return found + [label] * len(others), restored, whole


def sample_runs(texts: DataFrame, rows: int, longest: int = 60) -> list[str]:
    """At most `rows` different runs of non-ASCII characters with their neighbours, cut after `longest` characters; the
    same ones for the same texts."""
    found = F.regexp_extract_all("text", F.lit(r"([\x00-\x7F]?[^\x00-\x7F]+[\x00-\x7F]?)"), F.lit(1))
    foreign = texts.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.explode(F.array_distinct(found)).alias("run"))
    distinct = foreign.select(F.substring("run", 1, longest).alias("run")).distinct()
    return [r["run"] for r in distinct.orderBy(F.xxhash64("run"), "run").limit(rows).collect()]


def garbled(texts: DataFrame, model: ChainModel | None = None, sample_rows: int = 800) -> DataFrame:
    """(doc_id, chain, restored, complete) of the texts with at least one garbled sequence.

    texts: doc_id and text; received_at is passed on where it is there, other columns are ignored. chain: the first chain
    found, 'lost' where characters were replaced for good, 'cut short' where a byte is gone. restored: the text with all
    invertible sequences put back. complete: nothing stays garbled. Null, empty and ASCII texts are never garbled.
    Without a model, one is trained on at most sample_rows runs of the collection.
    """
    model = model or train(sample_runs(texts, sample_rows))
    sent = texts.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.priors))
    kept = [c for c in ("doc_id", "received_at") if c in texts.columns]

    def run(batches):
        import pyarrow as pa

        repairer = Repairer(ChainModel(*sent.value))
        for batch in batches:
            rows = [(i, *repairer.repair(t)) for i, t in enumerate(batch.column("text").to_pylist())]
            rows = [r for r in rows if r[1]]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [*(batch.column(c).take(at) for c in kept), pa.array([r[1][0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "chain", "restored", "complete"])

    foreign = texts.select(*kept, "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept) + ", chain string, restored string, complete boolean"
    return foreign.mapInArrow(run, schema)


def garbled_reviews(reviews: DataFrame, restored: bool = True) -> DataFrame:
    """(doc_id, chain, restored, complete) of the reviews whose last delivery is garbled, or doc_id alone; every delivery is
    looked through."""
    found = garbled(reviews.select("doc_id", "received_at", "text"))
    return of_last_delivery(found if restored else found.select("doc_id", "received_at"), reviews)
