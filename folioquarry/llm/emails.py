"""What the sender of an email newly wrote (p1).

Every email is parsed by its layout first: own header and attachment lines, quote prefixes, introductions and header
blocks of earlier messages, closing formulas, names and contact lines. What is left falls into sentences. Two passes over
all emails then decide about them by 64-bit SimHash fingerprints of their character n-grams:

* ``inherited``: sentences that an earlier message has, nearly word for word. A message's sentences are held against
  those of its conversation (the subject without its reply marks) and those of the message it answers
  (``parent_doc_id``), whatever its subject. Fingerprints within ``RADIUS`` (7) bits agree on one of four blocks of 16
  bits but for one bit, so the tables hold each fingerprint under all flips of a block; the length's class is part of the
  key. Candidates are verified by edit distance (``EDITS`` a character). Sentences are inherited from other senders'
  earlier messages, or copies of a message would erase each other; of each sentence of a conversation the two earliest
  senders are kept, which is all that is ever asked for, so a sentence that fills a third of all emails is one row.
* ``boilerplate``: notices, disclaimers, warnings and device lines are no list of phrases but what repeats: units
  (sentences that fill their lines, and lines) with the names of the parties masked, that stand where notices stand (above
  the text, below a signature, or last) in most of their places, and that a domain has in ``RATE`` of its conversations,
  or ``WIDE`` of all domains have, and two at least. Units in such a place that are within the radius of one that
  repeats, and within the edit distance, count with it.

Short sentences are inherited where they stand next to a longer one that is.

Defined cases: emails without text or body have no lines; emails without header lines are all body; delivered-twice pages
are read once; a message without a readable date is no one's source, but for an answer that names it as its parent, and
takes every dated message as earlier; line numbers count every line of the page from 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import timezone
from email.utils import parsedate_to_datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm import hashing as H
from folioquarry.plans.runtime import cut, small

BLOCKS, RADIUS, GRAM = 4, 7, 3
EDITS = 0.12  # edit distance per character
LAST = 4  # lines before earlier text or the end among which notices stand
RATE, WIDE = 0.03, 0.02  # share of a domain's conversations, or of all domains, from which a unit counts as boilerplate

# Words that mail programs, closings and greetings use, in four languages.
HEADERS = ("From", "Von", "De", "Sent", "Gesendet", "Envoyé", "Enviado", "Enviado el", "Date", "Datum", "Fecha", "To", "An", "À", "A", "Para", "Cc", "Kopie", "Subject", "Betreff", "Objet", "Asunto")
REPLY_MARKS = ("re", "fw", "fwd", "aw", "wg", "tr", "rv", "ref")
CLOSINGS = (
    "regards", "kind regards", "best regards", "warm regards", "best", "best wishes", "all the best", "cheers", "thanks", "many thanks", "with thanks", "thank you", "yours", "yours faithfully", "yours sincerely", "yours truly", "sincerely",
    "viele grüße", "beste grüße", "liebe grüße", "schöne grüße", "mit freundlichen grüßen", "freundliche grüße", "mfg", "hochachtungsvoll", "danke",
    "cordialement", "bien cordialement", "bien à vous", "salutations distinguées", "sincères salutations", "merci", "amicalement",
    "saludos", "saludos cordiales", "un saludo", "un cordial saludo", "cordialmente", "atentamente", "gracias", "muchas gracias",
)
GREETINGS = r"dear|hi|hello|hey|good (?:morning|afternoon|evening|day)|greetings|bonjour|bonsoir|cher|chère|chers|madame|monsieur|hallo|guten (?:morgen|tag|abend)|liebe|lieber|sehr geehrte[rs]?|hola|buenos días|buenas tardes|estimad[oa]s?(?:/[oa]s?)?"
PARTICLES = ("of", "and", "de", "la", "du", "für", "y", "et")

_HEADER = re.compile(rf"^\*?(?:{'|'.join(HEADERS)}) ?:\*? ?\S")
_FIRST = re.compile(r"^\*?(?:From|Von|De) ?:\*? ?\S")
_OWN = re.compile(r"^(From|To|Cc|Date): ?")
_QUOTE = re.compile(r"^\s*(?:>|\||[A-Z]{2,3}>(?: |$|>))")
_SEP = re.compile(r"^\s*(?:-{3,}.*(?:original|forwarded|origin|ursprüngliche|weitergeleitet|transféré|reenviado).*-{2,}|begin forwarded message:|début du message .*:|anfang der weitergeleiteten .*:|inicio del mensaje .*:)\s*$", re.I)
_RULE = re.compile(r"^(?:[-_*=~]{3,}|--) ?$")
_VERB = re.compile(r"\b(?:wrote|said|schrieb|a écrit|écrit|escribió)\b", re.I)
_TIME, _DAY = re.compile(r"\d{1,2}:\d{2}"), re.compile(r"\d{4}|\d{1,2}/\d{1,2}")
_BARE = re.compile(r"^[^\W\d_]\S* \S+(?: <[^>]*>)? (?:wrote|said|schrieb|a écrit|escribió) ?:$")
_ATTACHED = re.compile(r"^\[(?:attachment|attached|anhang|pièce jointe|adjunto)\b.*?\]?$", re.I)
_GREETING = re.compile(rf"^(?:(?:{GREETINGS})\b[^.?;$]{{0,60}}[,:!]?|[A-ZÀ-Þ][^\W\d_]+[,:!])$", re.I)
_NAME_ONLY = re.compile(r"^[A-ZÀ-Þ][^\W\d_]+[,:!]$")
_PS = re.compile(r"^p\.? ?p?\.? ?s\b\.?:?", re.I)
_PHONE = re.compile(r"^(?:(?:tel|phone|mobile|fax|téléphone|telefon|teléfono|m|t|f)\.?:? ?)?\+?\d[\d ()/.-]{6,}$", re.I)
_MAIL = re.compile(r"^\S+@\S*$")
_BROKEN_INTRO = re.compile(r"^(?:On|Am|Le|El|Den) .{4,40}\d{1,2}:\d{2}\b|^\*(?:From|Von|De):|^(?:From|Von|De): [^,]*<")
_ENDED = re.compile(r"[.!?:…][\"')\]]*\s*$")
_SENTENCE = re.compile(r"\S.*?(?:[.!?][\"')\]]*(?=\s)|$)")


def clean(line: str) -> str:
    return " ".join(H.WORD.findall(line.lower()))


class Message:
    """An email's lines with a label for each: what its layout alone tells."""

    def __init__(self, text: str, boiler: frozenset[int] = frozenset()):
        """``boiler``: the lines that are known to be boilerplate."""
        self.boiler = boiler
        self.lines = lines = text.split("\n")
        self.header: dict[str, str] = {}
        i = 1 if len(lines) > 1 and _OWN.match(lines[1]) else 0  # without header lines all is body
        while i and i < len(lines) and (m := _OWN.match(lines[i])) and m.group(1) not in self.header:
            self.header[m.group(1)] = lines[i][m.end() :].strip()
            i += 1
        self.start = i
        name = re.sub(r"<.*", "", self.header.get("From", "")).strip()
        mail = re.search(r"<([^>]*)>?", self.header.get("From", ""))
        self.sender = (mail.group(1) if mail else name).strip().lower()
        self.domain = self.sender.rpartition("@")[2]
        self.company = re.sub(r"\.[a-z]+$", "", self.domain)
        self.names = name.split()
        people = " ".join(self.header.get(k, "") for k in ("From", "To", "Cc")).lower()
        self.parties = set(H.WORD.findall(re.sub(r"\.[a-z]+(?=[>,\s]|$)", " ", people)))
        self.to = re.sub(r"<.*", "", self.header.get("To", "")).strip().split()
        self.thread = re.sub(rf"^(?:(?:{'|'.join(REPLY_MARKS)})\s*:\s*)+", "", lines[0].strip().lower()).strip()
        try:
            d = parsedate_to_datetime(self.header.get("Date", ""))
            self.at = int((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp())
        except (TypeError, ValueError):
            self.at = None
        self.labels = self._label()

    def _intro(self, i: int) -> int:
        """Number of lines of an introduction of earlier text that starts at line ``i``."""
        s = ""
        for n in range(1, 5):
            if i + n > len(self.lines):
                return 0
            line = self.lines[i + n - 1].strip()
            if not line or _QUOTE.match(line) or len(s) > 160:
                return 0
            if n > 1 and (_GREETING.match(self.lines[i + n - 2].strip()) or _RULE.match(self.lines[i + n - 2])):
                return 0
            s = f"{s} {line}".strip()
            if line.endswith(":") and _VERB.search(s):
                if _BARE.match(s):
                    return n
                if _TIME.search(s) and re.match(r"^(?:On|Am|Le|El|Den)\b.{0,40}\d|^[A-ZÀ-Þ]\S* [A-ZÀ-Þ]\S*(?: <[^>]*>)?,? (?:wrote|said)", s):
                    return n
        s = ""
        for n in range(1, 5):  # the time may follow the verb: "X said, 2024-01-01 10:00:"
            if i + n > len(self.lines):
                return 0
            line = self.lines[i + n - 1].strip()
            if not line or _QUOTE.match(line):
                return 0
            s = f"{s} {line}".strip()
            if line.endswith(":") and re.match(r"^[A-ZÀ-Þ]\S* [A-ZÀ-Þ]\S*(?: <[^>]*>)?,? (?:wrote|said)\b,?(?: on)?.{0,40}\d{1,2}:\d{2}:$", s):
                return n
        return 0

    def _is_name(self, line: str) -> bool:
        s = line.strip().rstrip(",")
        n = self.names
        return bool(n) and (s in (" ".join(n), n[0], n[-1]) or s == "".join(x[0] for x in n) or s == ".".join(x[0] for x in n))

    def _is_other(self, line: str) -> bool:
        """The name or initials of the one written to, as a signature under their text has them."""
        s, n = line.strip(), self.to
        return bool(n) and n != self.names and (s in (" ".join(n), n[0]) or len(n) > 1 and s == "".join(x[0] for x in n))

    def _is_company(self, line: str) -> bool:
        s = re.sub(r"[^a-z0-9]", "", line.lower().replace("&", ""))
        return bool(s) and s == re.sub(r"[^a-z0-9]", "", self.company)

    def _label(self) -> list[str]:
        lines = self.lines
        out = ["head"] * self.start + [""] * (len(lines) - self.start)
        i, block, mark = self.start, False, False
        while i < len(lines):
            raw, line = lines[i], lines[i].strip()
            if _ATTACHED.match(line):
                out[i] = "attached"
            elif not line:
                out[i] = "blank"
            elif _QUOTE.match(raw):
                out[i] = "quote"
            elif _SEP.match(raw):
                out[i] = "mark"
                nxt = next((x for x in lines[i + 1 :] if x.strip()), "")
                block = block or not _QUOTE.match(nxt)
            elif _FIRST.match(line) and i + 1 < len(lines) and _HEADER.match(lines[i + 1].strip()):
                while i < len(lines) and _HEADER.match(lines[i].strip()):
                    out[i] = "mark"
                    i += 1
                block = True
                continue
            elif n := self._intro(i):
                nxt = next((x for x in lines[i + n :] if x.strip()), "")
                block = block or not _QUOTE.match(nxt)
                out[i : i + n] = ["mark"] * n
                i += n
                continue
            elif block:
                out[i] = "earlier"
            i += 1
        # Where the text breaks off within an introduction, a header line or a closing.
        end = next((i for i in range(len(lines) - 1, self.start, -1) if lines[i].strip()), None)
        for i in (end,) if end is None or end - 1 <= self.start else (end, end - 1):
            if i is not None and not out[i] and _BROKEN_INTRO.match(lines[i].strip()):
                out[i : end + 1] = ["mark"] * (end + 1 - i)
        if end is not None and not out[end] and len(lines[end].strip()) > 3 and any(c.startswith(lines[end].strip().lower()) for c in CLOSINGS):
            out[end] = "closing"
        # Signature parts of what is left, and of earlier text (``inner``): they need the lines about them.
        self.inner, self.labels_so_far = [""] * len(lines), out
        signing = False
        for i, label in enumerate(out):
            line = lines[i].strip()
            if label and label != "earlier":
                signing = signing and label == "blank"
                continue
            if label == "earlier":
                self.inner[i], signing = self._part(i, signing)
            else:
                out[i], signing = self._part(i, signing)
        return out

    def _part(self, i: int, signing: bool) -> tuple[str, bool]:
        """Label of an unquoted line, and whether the lines after it are in a signature."""
        lines, line = self.lines, self.lines[i].strip()
        if line.lower().rstrip(",.! ") in CLOSINGS:
            return "closing", True
        if _RULE.match(lines[i]):
            return "rule", True
        if _PS.match(line):
            return "ps", False
        if i in self.boiler:
            return "notice", signing
        if _PHONE.match(line) or _MAIL.match(line) or self._is_company(line):
            return "contact", True
        if self._is_name(line) and not line.endswith(","):
            return "name", True
        if self._is_other(line) or (i < len(self.labels_so_far) and self.labels_so_far[i] == "earlier" and re.fullmatch(r"[A-Z]{2,3}", line)):
            return "other", True
        if " | " in line and len(line) < 120 and (signing or line.split(" | ")[0].strip() == " ".join(self.names) or re.search(r"\| \+?\d[\d ]{6,}$", line)):
            return "contact", True
        if signing and not _GREETING.match(line) and len(line) < 40 and len(line.split()) <= 4 and not re.search(r"[.!?;:,]$", line) and all(w[:1].isupper() or not w[:1].isalpha() or w in PARTICLES for w in line.split()):
            return "contact", True
        if _GREETING.match(line):
            return "greeting", False
        return "", False

    def edges(self) -> set[int]:
        """Lines that stand where notices stand: first of all, below a signature or a rule, or among the last before earlier text or the end."""
        out: set[int] = set()
        run: list[int] = []
        after, first = False, True
        for i in range(self.start, len(self.lines)):
            label = self.inner[i] if self.labels[i] == "earlier" else self.labels[i]
            if label == "blank" or self.labels[i] == "earlier" and not self.lines[i].strip():
                continue
            if label in ("quote", "mark", "attached"):
                out.update(run[-LAST:])
                after, run = False, []
            elif label == "greeting":
                after, run = False, []
            elif label in ("closing", "rule", "name", "contact", "other"):
                after = True
            else:
                run.append(i)
                if after or first:
                    out.add(i)
            first = False
        return out.union(run[-LAST:])

    def whole_lines(self) -> list[int]:
        """Unlabelled lines of three words or more that don't go on with the line before."""
        out, going = [], False
        for i in range(self.start, len(self.lines)):
            plain = self.labels[i] == "" or self.labels[i] == "earlier" and self.inner[i] == ""
            if plain and not going and len(self.lines[i].split()) >= 3:
                out.append(i)
            going = plain and not _ENDED.search(self.lines[i])
        return out

    def masked(self, words: str) -> str:
        """``words`` with the names of the parties and of their companies as one sign."""
        out: list[str] = []
        for w in words.split():
            w = "@" if w in self.parties else w
            if w != "@" or not out or out[-1] != "@":
                out.append(w)
        return " ".join(out)

    def sentences(self) -> list[tuple[str, int, int, str]]:
        """(words, first line, last line, kind) of all sentences; kind is ``own`` (unquoted), ``earlier`` or ``quote``."""
        out = []
        for kind in ("own", "earlier", "quote"):
            i, n = self.start, len(self.lines)
            while i < n:
                if not self._in(i, kind):
                    i += 1
                    continue
                s, at = "", []
                part = self.inner[i] if kind == "earlier" else self.labels[i]
                while i < n and self._in(i, kind) and (self.inner[i] if kind == "earlier" else self.labels[i]) == part:
                    line = self.lines[i].strip()
                    if kind == "quote":
                        line = re.sub(r"^(?:\s*(?:>|\||[A-Z]{2,3}>) ?)+", "", self.lines[i]).strip()
                        if not line or _GREETING.match(line) or line.lower().rstrip(",. ") in CLOSINGS:
                            i += 1
                            break
                    at.append((len(s), i))
                    s += line + " "
                    i += 1
                    if part == "notice":
                        break
                for m in _SENTENCE.finditer(s):
                    words = clean(m.group())
                    if words:
                        out.append((words, max(x for p, x in at if p <= m.start()), max(x for p, x in at if p < m.end()), kind))
        return out

    def _in(self, i: int, kind: str) -> bool:
        if kind == "own":
            return self.labels[i] in ("", "ps", "notice")
        return self.labels[i] == kind and (kind == "quote" or self.inner[i] in ("", "ps", "notice"))


def _greets_another(m: Message, line: str) -> bool:
    """Whether a greeting ends with the name of someone the message isn't written to."""
    g = re.search(r"([A-ZÀ-Þ][^\W\d_]+)\W*$", line.strip())
    named = g is not None and (_NAME_ONLY.match(line.strip()) or len(line.split()) > 1) and g.group(1).lower() not in ("all", "damen", "herren", "madame", "monsieur", "team", "everyone", "sir")
    return bool(named and m.to and g.group(1) not in m.to)


def boiler_lines(sentences: list[tuple[int, int, bool]], lines: set[int]) -> frozenset[int]:
    """The lines of which all is boilerplate: as lines, or by all their sentences (first line, last line, boilerplate)."""
    rest = {i for first, last, boiler in sentences if not boiler for i in range(first, last + 1)}
    return frozenset(lines | ({i for first, last, boiler in sentences if boiler for i in range(first, last + 1)} - rest))


def decide(m: Message, sentences: list[tuple[int, int, bool, bool]]) -> list[int]:
    """Numbers of the newly written lines; ``sentences`` has (first line, last line, inherited, short and inherited) of the unquoted and earlier ones."""
    n = len(m.lines)
    fresh = np.zeros(n, dtype=bool)
    at: dict[int, list[tuple[bool, bool]]] = {}
    for first, last, inherited, short in sentences:
        for i in range(first, last + 1):
            at.setdefault(i, []).append((inherited, short))
    # Segments of unquoted lines: one ends with a signature, before a greeting, and at quotes and marks.
    segments: list[list[int]] = [[]]
    signed = False
    for i in range(m.start, n):
        label = m.labels[i]
        if label in ("quote", "mark", "earlier", "attached"):
            segments.append([])
            signed = False
            continue
        if label == "blank":
            continue
        if label == "greeting" or (signed and label in ("", "ps")):
            segments.append([])
            signed = False
        segments[-1].append(i)
        signed = signed or label in ("closing", "rule", "name", "contact", "other")
    me = m.names[0].lower() if m.names else None
    for seg in segments:
        if not seg:
            continue
        prose = [i for i in seg if m.labels[i] in ("", "ps")]
        held = [i for i in prose if any(inh for inh, _ in at.get(i, []))]
        hello = next((m.lines[i].strip() for i in seg if m.labels[i] == "greeting"), "")
        to_me = me is not None and re.search(rf"\b{re.escape(me)}\W*$", hello.lower()) is not None and (not m.to or m.to[0].lower() != me)
        mine = any(m.labels[i] == "name" for i in seg)
        signed = any(m.labels[i] == "other" for i in seg)
        if signed and not held or to_me and not held and not mine:
            continue  # someone else's text: they signed it, or it greets the sender
        # Earlier text stands in one piece: from the greeting before its first known sentence to its last one, or to its signature.
        low, high = (min(held), n if signed else max(held)) if held else (n, -1)
        for i in reversed(prose):  # short sentences next to it are part of it
            low = i if held and i == max((x for x in prose if x < low), default=-1) and at.get(i) and all(a or b for a, b in at[i]) else low
        for i in prose:
            high = i if held and i == min((x for x in prose if x > high), default=-1) and at.get(i) and all(a or b for a, b in at[i]) else high
        for i in seg:
            if m.labels[i] == "greeting":
                fresh[i] = not to_me and not (held and low <= min(prose)) and not _greets_another(m, m.lines[i])
            elif m.labels[i] in ("", "ps") and not low <= i <= high:
                fresh[i] = True
    # Below a block of earlier text, which has no marks at its end.
    below = [i for i in range(m.start, n) if m.labels[i] == "earlier"]
    known = {i for i in below if m.inner[i] in ("", "ps") and any(inh for inh, _ in at.get(i, []))}
    if below and not fresh[: below[0]].any():
        prose = [i for i in below if m.inner[i] in ("", "ps")]
        if known:  # the sender's words follow the last line of it that is known
            mine = [i for i in prose if i > max(known)]
        else:  # or they are the last piece, which the sender signed
            names = [i for i in below if m.inner[i] == "name"]
            top = max((i for i in below if m.inner[i] == "greeting" and names and i < names[-1]), default=None)
            mine = [i for i in prose if names and top is not None and top < i < names[-1]]
            if any(m.inner[i] == "other" or m.labels[i] == "mark" for i in range(mine[0], mine[-1])) if mine else False:
                mine = []
        fresh[mine] = True
        if mine:
            hello = [i for i in below if m.inner[i] == "greeting" and i < mine[0] and i > max(known, default=-1)]
            if hello and all(m.labels[i] == "blank" for i in range(hello[-1] + 1, mine[0])):
                fresh[hello[-1]] = True
    last = next((i for i in range(n - 1, m.start - 1, -1) if m.labels[i] not in ("blank", "attached") and m.inner[i] not in ("notice", "rule")), None)
    if last is not None and m.inner[last] == "ps" and last not in known:
        fresh[last] = True
    return [i + 1 for i in np.flatnonzero(fresh)]


def fingerprints(texts: list[str], slab: int = 1000) -> np.ndarray:
    """SimHashes of many texts over their runs of ``GRAM`` characters, ``slab`` texts at once."""
    if len(texts) > slab:
        return np.concatenate([fingerprints(texts[i : i + slab], slab) for i in range(0, len(texts), slab)])
    if not texts:
        return np.zeros(0, dtype=np.uint64)
    padded = [f" {t} ".ljust(GRAM) for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded])
    owner = np.repeat(np.arange(len(texts)), sizes)
    grams = H.shingles(H.mix(codes + np.uint64(1)), GRAM)
    inside = owner[: len(grams)] == owner[GRAM - 1 :]
    bits = np.unpackbits(grams[inside].view(np.uint8).reshape(-1, 8), axis=1)
    first = np.searchsorted(owner[: len(grams)][inside], np.arange(len(texts)))
    votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > (sizes - GRAM + 1)[:, None], axis=1).view(np.uint64).ravel()


def with_fingerprints(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the fingerprint ``fp`` of a text column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(fp=H.signed(fingerprints(pdf[text].tolist())))

    return df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", fp bigint")


def near_texts(left: DataFrame, right: DataFrame, group: str | None) -> DataFrame:
    """``x``, ``y`` of the rows (x, text, fp[, group]) and (y, text, fp[, group]) of a group whose fingerprints are within ``RADIUS`` and whose texts within the edit distance."""
    width = 64 // BLOCKS
    size = F.floor(F.log(F.length("text").cast("double")) / math.log(1 + EDITS)).cast("int")  # texts within the edit distance are in classes next to each other
    part = f"(shiftrightunsigned(fp, i % {BLOCKS} * {width}) & {(1 << width) - 1})"
    turn = f"cast(i div {BLOCKS} as int)"
    flip = f"if({turn} = 0, 0L, shiftleft(1L, {turn} - 1))"
    # For every block: the three size classes on one side, no flip and a flip of each bit on the other.
    keys = lambda n, value, cls: F.expr(f"explode(transform(sequence(0, {BLOCKS * n - 1}), i -> xxhash64({group + ', ' if group else ''}i % {BLOCKS}, {value}, {cls})))").alias("block")
    x = left.withColumn("size", size).select("x", F.col("text").alias("a"), F.col("fp").alias("fx"), keys(3, part, f"size + {turn} - 1"))
    y = right.withColumn("size", size).select("y", F.col("text").alias("b"), F.col("fp").alias("fy"), keys(width + 1, f"{part} ^ {flip}", "size"))
    near = x.drop("a").join(y.drop("b"), "block").where(F.bit_count(F.col("fx").bitwiseXOR(F.col("fy"))) <= RADIUS).select("x", "y").distinct()
    near = near.join(left.select("x", F.col("text").alias("a")), "x").join(right.select("y", F.col("text").alias("b")), "y")
    return near.where(F.levenshtein("a", "b") <= EDITS * F.greatest(F.length("a"), F.length("b"))).select("x", "y")


def email_pages(documents: DataFrame, doc_text: DataFrame) -> DataFrame:
    """``doc_id``, ``parent``, ``text`` of every email's page, once each."""
    parent = F.col("parent_doc_id") if "parent_doc_id" in documents.columns else F.lit(None).cast(dict(documents.dtypes)["doc_id"])
    ids = documents.where("parser = 'eml' and doc_id is not null").groupBy("doc_id").agg(F.min(parent).alias("parent"))
    pages = doc_text.where("text is not null").select("doc_id", "page", "text").join(small(ids), "doc_id")
    return pages.groupBy("doc_id").agg(F.min("parent").alias("parent"), F.min(F.struct("page", "text")).alias("p")).select("doc_id", "parent", "p.text")


def parsed(emails: DataFrame) -> DataFrame:
    """A row for each sentence and, for boilerplate, for each line: where it stands, and who wrote it when in which conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, parent, text in zip(pdf["doc_id"], pdf["parent"], pdf["text"]):
                m = Message(text)
                edges = m.edges()
                meta = (d, parent, m.thread, m.sender, m.domain, m.at)
                for no, (words, first, last, kind) in enumerate(m.sentences()):
                    asked = kind == "own" and m.labels[first] in ("", "ps") or kind == "earlier" and m.inner[first] in ("", "ps")
                    rows.append((*meta, 2 * no, words, asked, m.masked(words) if asked else None, first in edges))
                for i in m.whole_lines():
                    rows.append((*meta, 2 * i + 1, None, False, m.masked(clean(m.lines[i])), i in edges))
            yield pd.DataFrame(rows, columns=["doc_id", "parent", "thread", "sender", "domain", "at", "no", "words", "own", "unit", "edge"]).astype({"at": "Int64"})

    kind = dict(emails.dtypes)["doc_id"]  # ids pass Python as strings: with nulls they would become floats there
    out = emails.select("doc_id", F.col("parent").cast("string").alias("parent"), "text").mapInPandas(run, f"doc_id {kind}, parent string, thread string, sender string, domain string, at bigint, no int, words string, own boolean, unit string, edge boolean")
    return out.withColumn("parent", F.col("parent").cast(dict(emails.dtypes)["parent"]))


def two_earliest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows (key, at, who): the earliest of each key, ``e1``, and the earliest by someone else, ``e2``."""
    per = rows.groupBy(*key, "who").agg(F.min("at").alias("at"))
    first = per.groupBy(*key).agg(F.min(F.struct("at", "who")).alias("e1"))
    other = per.join(first, [*key]).where("who <> e1.who").groupBy(*key).agg(F.min(F.struct("at", "who")).alias("e2"))
    return first.join(other, [*key], "left")


def inherited(sentences: DataFrame) -> DataFrame:
    """``doc_id``, ``no``, ``short`` of the own sentences that an earlier message has, nearly word for word."""
    s = sentences.where("words is not null").select("doc_id", "parent", "no", "at", "own", "words", F.xxhash64("words").alias("w"), F.xxhash64("thread").alias("thread"), F.xxhash64("sender").alias("sender"))
    talk = s.select(F.struct(F.lit(0).alias("k"), F.col("thread").cast("string").alias("v")).alias("g"), F.col("sender").alias("who"), "doc_id", "no", "at", "own", "words", "w")
    # The message answered: its conversation is the pair's own where the subjects differ; it is earlier whatever the dates say.
    of = s.select("doc_id", "parent", "thread").distinct()
    apart = of.where("parent is not null").select("doc_id", "parent", "thread").join(of.select(F.col("doc_id").alias("parent"), F.col("thread").alias("t2")), "parent").where("thread <> t2").select("doc_id", "parent")
    apart = small(cut(apart))
    pair = F.struct(F.lit(1).alias("k"), F.col("parent").cast("string").alias("v")).alias("g")
    asks = s.where("own").drop("parent").join(apart, "doc_id").select(pair, F.lit(1).cast("bigint").alias("who"), "doc_id", "no", F.lit(1 << 60).alias("at"), "own", "words", "w")
    gives = s.drop("parent").join(apart.select(F.col("parent").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.struct(F.lit(1).alias("k"), F.col("doc_id").cast("string").alias("v")).alias("g"), F.lit(0).cast("bigint").alias("who"), "doc_id", "no", F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("own"), "words", "w")
    s = talk.unionByName(asks).unionByName(gives)
    several = s.groupBy("g").agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a <> b").select("g")
    s = s.join(several, "g", "left_semi")
    # A sentence of a conversation is one row.
    kept = s.groupBy("g", "w", "who").agg(F.min("at").alias("at"), F.max("own").alias("own"), F.first("words").alias("words"))
    kept = cut(kept)
    sources = kept.where("at is not null").select("g", "w", "who", "at")
    long = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) >= 3
    texts = kept.where(long).groupBy("g", "w").agg(F.first("words").alias("text"), F.max("own").alias("own"), F.max(F.col("at").isNotNull()).alias("dated"))
    texts = cut(_fingerprinted(texts))
    near = near_texts(texts.where("own").select("x", "text", "fp", "group"), texts.where("dated").select(F.col("x").alias("y"), "text", "fp", "group"), "group").where("x <> y")
    keys = texts.select("x", "g", "w")
    close = near.join(keys, "x").join(texts.select(F.col("x").alias("y"), F.col("w").alias("wy")), "y").select("g", "w", "wy")
    copies = close.join(sources.withColumnRenamed("w", "wy"), ["g", "wy"]).select("g", "w", "who", "at")
    since = two_earliest(sources.unionByName(copies), "g", "w")
    mine = s.where("own").select("g", "w", "doc_id", "no", "who", F.coalesce("at", F.lit(1 << 60)).alias("at"), (~long).alias("short"))
    got = mine.join(since, ["g", "w"]).where(F.when(F.col("e1.who") != F.col("who"), F.col("e1.at")).otherwise(F.col("e2.at")) < F.col("at"))
    return got.groupBy("doc_id", "no").agg(F.min("short").alias("short"))


def _fingerprinted(texts: DataFrame) -> DataFrame:
    """Rows (x, group, g, w, text, own, dated, fp) of a conversation's sentences."""
    t = texts.select(F.xxhash64("g", "w").alias("x"), F.xxhash64("g").alias("group"), F.col("g.k").alias("k"), F.col("g.v").alias("v"), "w", "text", "own", "dated")
    return with_fingerprints(t, "text").withColumn("g", F.struct("k", "v")).drop("k", "v")


def boilerplate(units: DataFrame) -> DataFrame:
    """``doc_id``, ``no`` of the units that repeat at a rate where notices stand, and of those near them there."""
    u = units.where("unit <> ''").select("doc_id", "no", F.xxhash64("domain").alias("domain"), F.xxhash64("thread").alias("thread"), "unit", F.xxhash64("unit").alias("w"), "edge", F.coalesce("at", F.col("doc_id").cast("bigint")).alias("at"))
    talks = units.select(F.xxhash64("domain").alias("domain"), F.xxhash64("thread").alias("thread")).distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("talks"))
    talks = cut(talks)
    domains = talks.count()
    # Only what stands at such a place at all can be boilerplate: the others are counted for those alone.
    edge = cut(u.where("edge"))
    # Copies of a message have its conversation or its date.
    places = edge.groupBy("w", "domain", "thread").agg(F.lit(1).alias("one"))
    talk = places.groupBy("w", "domain").agg(F.count(F.lit(1)).alias("n"))
    time = edge.groupBy("w", "domain", "at").agg(F.lit(1).alias("one")).groupBy("w", "domain").agg(F.count(F.lit(1)).alias("m"))
    per = talk.where("n > 1").join(time.where("m > 1"), ["w", "domain"]).select("w", "domain", F.least("n", "m").alias("n"))
    owners = talk.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) & (F.col("n") >= domains * WIDE))
    talks_of = places.select("w", "thread").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("m")).where("m >= 3")  # a sentence pasted on in one conversation is none
    per = per.join(talks, "domain").select("w", "domain", "n", "talks")
    often = per.where((F.col("n") >= 2) & (F.col("n") >= F.col("talks") * RATE)).select("w").distinct()
    wide = owners.join(talks_of, "w").select("w")
    some = often.unionByName(wide).distinct()
    stands = u.join(some, "w", "left_semi").groupBy("w").agg(F.avg(F.col("edge").cast("double")).alias("share"), F.min("unit").alias("text"))
    known = stands.where("share >= 0.5").select("w", "text", F.lit(True).alias("known"))
    rest = edge.groupBy("w").agg(F.first("unit").alias("text")).join(known.select("w"), "w", "left_anti").withColumn("known", F.lit(False))
    prints = cut(with_fingerprints(known.unionByName(rest), "text"))
    long = prints.where(F.length("text") >= 20)
    near = near_texts(long.where("not known").withColumnRenamed("w", "x"), long.where("known").withColumnRenamed("w", "y"), None)
    known = prints.where("known").select(F.col("w").alias("x"))
    exact = u.join(known.select(F.col("x").alias("w")), "w", "left_semi").select("doc_id", "no")
    return exact.unionByName(edge.join(near.select(F.col("x").alias("w")).distinct(), "w", "left_semi").select("doc_id", "no")).distinct()


def new_lines(documents: DataFrame, doc_text: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no`` of the newly written lines of every email."""
    emails = cut(email_pages(documents, doc_text))
    units = cut(parsed(emails))
    old = inherited(units).select("doc_id", (F.col("no") * 4 + F.when(F.col("short"), 1).otherwise(0)).alias("mark"))
    marks = old.unionByName(boilerplate(units).select("doc_id", (F.col("no") * 4 + 2).alias("mark")))
    marks = marks.groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))  # an email's own sentences and lines

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, lines = [], []
            for d, text, marks in zip(pdf["doc_id"], pdf["text"], pdf["marks"]):
                got = reduce_email(text, set() if marks is None else set(map(int, marks)))
                ids.extend([d] * len(got))
                lines.extend(got)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype), "line_no": np.array(lines, dtype=np.int32)})

    kind = dict(emails.dtypes)["doc_id"]
    return emails.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInPandas(run, f"doc_id {kind}, line_no int")


def reduce_email(text: str, marks: set[int]) -> list[int]:
    """Numbers of the newly written lines, given the marks of sentences (8 x number: inherited, + 1: short, + 2: boilerplate) and lines (8 x number + 6: boilerplate)."""
    m = Message(text)
    sentences = m.sentences()
    if any(x & 2 for x in marks):
        lines = {x >> 3 for x in marks if x & 7 == 6}
        m = Message(text, boiler_lines([(first, last, 8 * k + 2 in marks) for k, (_, first, last, kind) in enumerate(sentences) if kind != "quote"], lines))
    return decide(m, [(first, last, 8 * k in marks, 8 * k + 1 in marks) for k, (_, first, last, kind) in enumerate(sentences) if kind != "quote"])
