"""The lines of a message that its author did not newly write.

1. The message's own marks: lines with a quote prefix, the headings of quoted and forwarded
   messages and what follows them, dividers and contact lines under the author's name,
   notes of devices, legal notices at the end of the author's own lines.
2. Per thread, a generalised suffix automaton over the words of what the thread's messages
   quote and of earlier messages by other senders. Lines of which most words lie in runs of
   RUN words or more that it accepts are inherited, however they are wrapped. Threads of
   more than MAX_THREAD messages or MAX_CHARS characters, which no task should hold, get the
   same runs from a join on the hash of each RUN words, by the same order of messages: by
   time, those without one last, then by item and field.
3. Per sender, what recurs at the end of the author's own lines in RECUR messages or more:
   below the closing words or the name whole endings of any length, sentences too, where
   the lines above differ (else the messages are copies); elsewhere up to TAIL short lines
   that are no sentences. Greetings, closing words and bare names stay.

Lines end at line feeds and count from 1; a line without a visible character is no line.
Defined cases: null and empty messages have no line; null threads and senders share
nothing with others; an item that comes twice counts once, with the text that sorts first;
messages of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.automaton import SuffixAutomaton
from scriptorium.llm.words import mix, word_hashes, words
from scriptorium.session import cut

#: Words of the shortest run that counts as inherited, and the share of a line that must be.
RUN = 12
SHARE = 0.8
MAX_THREAD = 500
MAX_CHARS = 4_000_000
#: Threads, of a few bytes each, that may be broadcast.
FEW = 1_000_000
#: Messages of a sender in which a line must end the text to be its standing ending.
RECUR = 3
#: Own lines at the end of a message that may be a standing ending.
TAIL = 4

_GAP = "[ \t\xa0  　]"
_PREFIX = re.compile(rf"{_GAP}*(?:[>|]{_GAP}?)+")
_VISIBLE = re.compile(r"[^\s​-‏  ⁠﻿­\x00-\x1f]")
# Words of mail headings, device notes, closings and legal notices in five languages.
_WROTE = "wrote|writes|schrieb|a écrit|escribió|ha scritto"
_ATTRIBUTION = re.compile(
    rf"(?:On|Am|Le|El|Il)\b.*\d.*\b(?:{_WROTE})\b[^.!?]{{0,80}}[:：]$|.{{1,80}}\b(?:{_WROTE})\s+(?:on|am|le|el|il)\b.*\d.*[:：]$"
)
_OPENS = re.compile(r"(?:On|Am|Le|El|Il)\b.*\d|.{1,80}\b(?:wrote|schrieb|a écrit|escribió)\s")
_FORWARD = re.compile(
    r"[-_*=]{3,}\s*[^\W\d_].{0,80}?[-_*=]{3,}$"
    r"|(?:Begin forwarded message|Anfang der weitergeleiteten (?:Nachricht|E-Mail)|Début du message (?:réexpédié|transféré)|Inicio del mensaje reenviado)\s*:$"
)
_HEADER = re.compile(
    r"\*?(?:From|Sent|To|Cc|Date|Subject|Von|Gesendet|An|Datum|Betreff|De|Envoyé|À|A|Date|Objet|Enviado|Para|Fecha|Asunto|CC)\s*\*?\s*[:：]\s*\*?\s*\S?",
    re.I,
)
_FIRST_HEADER = re.compile(r"\*?(?:From|Von|De)\s*\*?\s*[:：]", re.I)
_DEVICE = re.compile(
    r"(?:sent (?:from|via) my|von mein\w*|gesendet (?:von|mit) mein\w*|envoyé (?:de|depuis) mon|enviado (?:desde|de) mi|inviato da(?:l mio)?|get outlook for)\b.{0,60}$", re.I
)
_NOTICE = re.compile(
    r"may be privileged|only for the (?:addressee|recipient)|intended recipient|confidentiality notice|confidential and|vertrauliche informationen"
    r"|damage caused by|contract is formed|author and not of|destroy every copy|before printing|monitored for|copying, disclosure|disclosure or use"
    r"|unauthori[sz]ed|haftung|rechtlich geschützt|informations? confidentielle|información confidencial|destinatari|destinataire",
    re.I,
)
_CLOSING = re.compile(
    r"(?:best|kind|warm|many|thanks|thank you|cheers|regards|sincerely|talk soon|yours|mit |viele |beste |liebe |lg\b|vg\b|mfg\b|gruß|cordialement|bien à"
    r"|amicalement|à bientôt|merci|un saludo|saludos|atentamente|gracias|un abrazo|hasta pronto)",
    re.I,
)
_NAME = re.compile(r"[-–—]?\s?[^\W\d_][\w.’'\-]*(?:,? [\w.’'\-]+){0,4}$")
_PHONE_LINE = re.compile(r"(?:T|Tel|Telefon|Tél|Phone|Mobile?|Mobil|Cell|M|P|F|Fax)\s?[.:]\s*[+(\d]", re.I)
_WEB_LINE = re.compile(r"(?:https?://)?www\.\S+$|https?://\S+$", re.I)
_DIVIDER = re.compile(r"(?:--+|__+|==+|\*\*\*+|~~+|—+)\s*$")
_PIPES = re.compile(r"[^|]+(?: \| [^|]+){2,}$")
_TITLE = re.compile(r"[A-ZÀ-Ý][\w&/.\- ]{0,40}, [A-ZÀ-Ý][\w&.’'\- ]{1,40}$")
_ADDRESS = re.compile(r"(?=.*\d).{5,80}, [^\W\d_][\w .’'\-]+$")


def _is_heading(lines: list[str], i: int) -> int:
    """How many lines from i are the heading of a quoted message with prefixed lines; 0 for none."""
    line = lines[i].strip()
    if not line or not _OPENS.match(line):
        return 0
    for more in range(3):
        if i + more >= len(lines):
            return 0
        if more:
            nxt = lines[i + more].strip()
            if not nxt:
                return 0
            line += " " + nxt
        if line.endswith((":", "：")):
            return more + 1 if len(line) < 240 and _ATTRIBUTION.match(line) else 0
    return 0


def _is_block(lines: list[str], i: int) -> bool:
    """Whether line i begins an unmarked quoted message: a forwarding line or a block of mail headers."""
    line = lines[i].strip()
    if _FORWARD.match(line):
        return True
    if not _FIRST_HEADER.match(line):
        return False
    return sum(bool(_HEADER.match(x.strip())) for x in lines[i + 1 : i + 5]) >= 2


def structure(text: str) -> tuple[list[str], list[str]]:
    """The lines of a message and the mark of each: q quoted, s signature, d notice, or none."""
    lines = [line.rstrip("\r") for line in text.split("\n")]
    marks = [""] * len(lines)
    prefixed = [bool(_PREFIX.match(line)) for line in lines]
    headed = False
    early: list[int] = []  # prefixed lines before any heading
    i = 0
    while i < len(lines):
        if prefixed[i]:
            if headed:
                marks[i] = "q"
            else:
                early.append(i)
        elif _is_block(lines, i):
            for k in range(i, len(lines)):
                marks[k] = "q"
            break
        elif more := _is_heading(lines, i):
            headed = True
            for k in range(i, i + more):
                marks[k] = "q"
            i += more
            continue
        i += 1
    _early_quotes(lines, marks, early)
    _endings(lines, marks)
    return lines, marks


def _early_quotes(lines: list[str], marks: list[str], early: list[int]) -> None:
    """Prefixed lines without a heading: a table's rows and a single line are the author's own."""
    run: list[int] = []
    quotes: list[int] = []
    for i in [*early, -1]:
        if run and i != run[-1] + 1:
            if not all(lines[k].strip().startswith("|") and lines[k].strip().endswith("|") and lines[k].count("|") > 2 for k in run):
                quotes += run
            run = []
        run.append(i)
    if len(quotes) > 1:
        for i in quotes:
            marks[i] = "q"


def _endings(lines: list[str], marks: list[str]) -> None:
    """Marks the signatures and notices at the ends of the author's own stretches of lines."""
    stretch: list[int] = []
    for i in [*range(len(lines)), -1]:
        if i >= 0 and not marks[i]:
            if _VISIBLE.search(lines[i]):
                stretch.append(i)
        elif stretch:
            _ending(lines, marks, stretch)
            stretch = []


def _ending(lines: list[str], marks: list[str], own: list[int]) -> None:
    blocks: list[list[int]] = [[own[0]]]
    for i in own[1:]:
        if i == blocks[-1][-1] + 1:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    while blocks:  # notices, whole blocks from the end
        block = blocks[-1]
        text = " ".join(lines[i].strip() for i in block)
        first = next((n for n, i in enumerate(block) if _NOTICE.search(lines[i])), None)
        if first is None and _NOTICE.search(text):
            first = 0
        if first is None:
            break
        start = 0 if _NOTICE.search(" ".join(lines[i].strip() for i in block[: first + 2])) and not _contact(lines, block[0]) and first < 2 else first
        for i in block[start:]:
            marks[i] = "d"
        if start:
            blocks[-1] = block[:start]
            break
        blocks.pop()
    tail = [i for block in blocks for i in block]
    for i in tail:
        if _DEVICE.match(lines[i].strip()):
            marks[i] = "s"
    tail = [i for i in tail if not marks[i]]
    if len(tail) > 1 and _DIVIDER.match(lines[tail[-1]].strip()):  # a line across, above what is quoted
        marks[tail.pop()] = "s"
    for n in range(max(0, len(tail) - 8), len(tail)):  # a divider with up to seven short lines under it
        if _DIVIDER.match(lines[tail[n]].strip()) and all(len(lines[i]) < 100 for i in tail[n + 1 :]):
            for i in tail[n:]:
                marks[i] = "s"
            return
    start = len(tail)
    while start and _contact(lines, tail[start - 1]):
        start -= 1
    found = tail[start:]
    if not any(_PHONE_LINE.match(lines[i].strip()) or _WEB_LINE.match(lines[i].strip()) or _PIPES.match(lines[i].strip()) for i in found) and not (
        found and start and _named(lines, tail, start) and len(found) < 4
    ):
        return
    for i in found:
        marks[i] = "s"
    name = lines[tail[start - 1]].strip() if start > 1 else ""
    if found and " " in name and _bare_name(name) and tail[start - 1] == found[0] - 1:
        above = lines[tail[start - 2]].strip()
        if tail[start - 2] < tail[start - 1] - 1 and (_bare_name(above) and not _CLOSING.match(above)):
            marks[tail[start - 1]] = "s"


def _bare_name(line: str) -> bool:
    line = line.strip()
    return bool(_NAME.match(line)) and len(line) < 50 and not line.endswith((".", "!", "?"))


def _named(lines: list[str], tail: list[int], start: int) -> bool:
    """Whether the author's name or initial, or closing words, stand right above the place."""
    above = lines[tail[start - 1]].strip()
    return _bare_name(above) or bool(_CLOSING.match(above))


def _contact(lines: list[str], i: int) -> bool:
    line = lines[i].strip()
    if len(line) > 100 or line.endswith(("!", "?")):
        return False
    if _PIPES.match(line):
        return True
    if line.endswith("."):
        return False
    if _PHONE_LINE.match(line) or _WEB_LINE.match(line):
        return True
    return not _CLOSING.match(line) and bool(_TITLE.match(line) or _ADDRESS.match(line))


def _standing(lines: list[str], own: list[int]) -> list[tuple[int, str, int]]:
    """(line, ending, context) of the lines below the last closing words or name among a message's own.

    An ending is the hash of a line with all below it, the context that of the last line of
    the text above the closing.
    """
    at = len(own)
    while at and not (_CLOSING.match(lines[own[at - 1]].strip()) or _bare_name(lines[own[at - 1]])):
        at -= 1
    if not 0 < at < len(own):
        return []
    above = at
    while above and (_CLOSING.match(lines[own[above - 1]].strip()) or _bare_name(lines[own[above - 1]])):
        above -= 1
    context = xxhash.xxh64_intdigest(lines[own[above - 1]].strip() if above else "")
    out, ending = [], ""
    for i in reversed(own[at:]):
        ending = xxhash.xxh64_hexdigest(ending + "\n" + lines[i].strip())
        out.append((i, ending, context))
    return out


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The marked lines of each message, and, without a mark, its last own lines that may be a standing ending."""
    names = ["item", "field", "line_no", "reason", "sender", "line", "context"]
    for batch in batches:
        out = []
        for item, field, sender, text in batch.itertuples(index=False):
            lines, marks = structure(text)
            own = []
            for i, (line, mark) in enumerate(zip(lines, marks)):
                if line and _VISIBLE.search(line):
                    if mark:
                        out.append((item, field, i + 1, mark, None, None, None))
                    else:
                        own.append(i)
            if sender is None:
                continue
            for i in own[: -TAIL - 1 : -1]:
                line = lines[i].strip()
                if len(line) >= 100 or line.endswith(("!", "?", ".", "-")) or _CLOSING.match(line) or _bare_name(line):
                    break  # what stands above is no ending
                out.append((item, field, i + 1, None, sender, line, xxhash.xxh64_intdigest(item) >> 1))
            out += [(item, field, i + 1, None, sender, f"\n{ending}", context >> 1) for i, ending, context in _standing(lines, own)]
        yield pd.DataFrame(out, columns=names)


def _inherit(rows: pd.DataFrame, least: int = RUN, share: float = SHARE) -> pd.DataFrame:
    """Own lines of a thread's messages that are inherited from others' text."""
    parsed = []
    quoted, written = SuffixAutomaton(), SuffixAutomaton()
    for row in rows.sort_values(["at", "item", "field"], na_position="last").itertuples(index=False):
        lines, marks = structure(row.text)
        parsed.append((row, *_own_words(lines, marks, "")))
        quoted.add(_own_words(lines, marks, "q")[0])
    out = []
    for row, found, owner in parsed:
        flags = [a or b for a, b in zip(quoted.inherited(found, least), written.inherited(found, least, row.sender))]
        written.add(found, row.sender)
        out += [(row.item, row.field, i + 1, "t") for i in _lines_of(owner, flags, share)]
    return pd.DataFrame(out, columns=["item", "field", "line_no", "reason"])


_OUT = "item string, field string, line_no int, reason string"


def old_lines(messages: DataFrame, most: tuple[int, int] = (MAX_THREAD, MAX_CHARS)) -> DataFrame:
    """(item, field, line_no, reason) of the lines not newly written.

    `messages` has item, field, thread, sender, at, text; reason is q quoted, s signature,
    d notice, t inherited in the thread, r recurring ending. `most` are the messages and
    characters of a thread that one task may hold; what is found is the same beyond.
    """
    rows = messages.where("item is not null and text is not null")
    read = rows.select("item", "field", "sender", "text").mapInPandas(_lines, f"{_OUT}, sender string, line string, context long")
    read = cut(read)
    marked = read.where("reason is not null").select("item", "field", "line_no", "reason")

    keyed = rows.where("thread is not null")
    each = keyed.groupBy("thread", "item", "field").agg(F.max(F.length("text")).alias("n"))
    sizes = cut(each.groupBy("thread").agg(F.count("*").alias("n"), F.sum("n").alias("chars")).where("n > 1"))
    big = (F.col("n") > most[0]) | (F.col("chars") > most[1])

    def messages_of(threads: DataFrame) -> DataFrame:
        if threads.limit(FEW + 1).count() <= FEW:  # then messages alone in their thread are not shuffled
            threads = F.broadcast(threads)
        once = keyed.join(threads, "thread", "left_semi").groupBy("thread", "item", "field").agg(F.min(F.struct("text", "sender", "at")).alias("m"))
        return once.select("thread", "item", "field", "m.sender", "m.at", "m.text")

    inherited = messages_of(sizes.where(~big).select("thread")).groupBy("thread").applyInPandas(lambda r: _inherit(r), _OUT)
    large = messages_of(sizes.where(big).select("thread"))

    tails = read.where("reason is null").drop("reason").distinct()
    common = tails.groupBy("sender", "line").agg(F.countDistinct("context").alias("n")).where(F.col("n") >= RECUR).select("sender", "line")
    recurring = tails.join(common, ["sender", "line"], "left_semi").select("item", "field", "line_no", F.lit("r").alias("reason"))

    every = marked.unionByName(inherited).unionByName(_inherited_by_join(large)).unionByName(recurring)
    return every.groupBy("item", "field", "line_no").agg(F.min("reason").alias("reason"))


def _own_words(lines: list[str], marks: list[str], mark: str) -> tuple[list[str], list[int]]:
    """The words of the lines with a mark, and the line of each."""
    found, owner = [], []
    for i, (line, m) in enumerate(zip(lines, marks)):
        if m == mark:
            w = words(line)
            found += w
            owner += [i] * len(w)
    return found, owner


def _lines_of(owner: list[int], flags: list[bool], share: float) -> list[int]:
    """The lines of whose words the share or more is flagged."""
    counts: dict = {}
    for i, flag in zip(owner, flags):
        n, m = counts.get(i, (0, 0))
        counts[i] = (n + 1, m + flag)
    return [i for i, (n, m) in counts.items() if m >= share * n]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each run of RUN words, of quoted text (own false) and of own text, with its first word's place."""
    for batch in batches:
        out = []
        for item, field, thread, sender, at, text in batch.itertuples(index=False):
            lines, marks = structure(text)
            for own, mark in ((False, "q"), (True, "")):
                found, _ = _own_words(lines, marks, mark)
                if len(found) < RUN:
                    continue
                h = word_hashes(found)
                run = h[: len(h) - RUN + 1].copy()
                for k in range(1, RUN):
                    run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - RUN + 1 + k])
                out += [(thread, int(value), own, item, field, sender, at, start) for start, value in enumerate(run.view(np.int64))]
        yield pd.DataFrame(out, columns=["thread", "run", "own", "item", "field", "sender", "at", "start"])


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The inherited lines of messages, from the places of their inherited runs."""
    for batch in batches:
        out = []
        for item, field, text, starts in batch.itertuples(index=False):
            found, owner = _own_words(*structure(text), "")
            flags = np.zeros(len(found), bool)
            for start in starts:
                flags[start : start + RUN] = True
            out += [(item, field, i + 1, "t") for i in _lines_of(owner, flags.tolist(), SHARE)]
        yield pd.DataFrame(out, columns=["item", "field", "line_no", "reason"])


def _inherited_by_join(rows: DataFrame) -> DataFrame:
    """Inherited lines of threads too large for a task: of each run only quotes and its first messages by two senders matter."""
    schema = "thread string, run long, own boolean, item string, field string, sender string, at timestamp, start int"
    runs = rows.select("item", "field", "thread", "sender", "at", "text").mapInPandas(_runs, schema)
    runs = runs.withColumn("place", F.struct(F.col("at").isNull().alias("late"), F.coalesce("at", F.lit(0).cast("timestamp")).alias("at"), "item", "field"))
    by = runs.where("own").groupBy("thread", "run", "sender").agg(F.min("place").alias("place"))
    by = by.withColumn("k", F.row_number().over(Window.partitionBy("thread", "run").orderBy("place"))).where("k <= 2")
    of = lambda c, k: F.min(F.when(F.col("k") == k, F.col(c)))
    first = by.groupBy("thread", "run").agg(of("place", 1).alias("first"), of("sender", 1).alias("first_sender"), of("place", 2).alias("other"))
    quoted = runs.where("not own").select("thread", "run").distinct().withColumn("quoted", F.lit(True))
    hit = runs.where("own").join(quoted, ["thread", "run"], "left").join(first, ["thread", "run"], "left")
    before = F.when(F.col("sender").eqNullSafe(F.col("first_sender")), F.col("other")).otherwise(F.col("first"))
    hit = hit.where(F.coalesce("quoted", F.lit(False)) | F.coalesce(before < F.col("place"), F.lit(False)))
    starts = hit.groupBy("thread", "item", "field").agg(F.collect_set("start").alias("starts"))
    return rows.join(starts, ["thread", "item", "field"]).select("item", "field", "text", "starts").mapInPandas(_covered, _OUT)
