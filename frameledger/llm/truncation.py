"""Texts cut off by a field limit or in mid-transfer.

A stack automaton reads the whole text: brackets, paired and straight quotes, code fences and markup
are pushed and popped, and every sentence is a frame that only a terminator closes. Page lines, marks
of omission and closing lines (signature, place and date, list of citations, bracketed notes) after
the end are set aside; a text is complete if the automaton then stands with an empty stack and no
broken character, escape or tag. What a source does throughout is no sign of a cut: a missing or weak
terminator (a lone initial, an abbreviation, a short number) and a frame left open in a text that ends
properly are held against how often that source's own paragraphs and texts show them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.operators.common import cut

#: Brackets and quotes with what closes them.
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“”", "“": "”", "‹": "›", "‚": "‘’"}
_CLOSERS = frozenset("".join(PAIRS.values()))
_QUOTES = frozenset("«„“‹‚\"")
#: Elements of HTML that have no end tag.
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
#: Abbreviations that a sentence rarely ends with.
_ABBREVIATIONS = frozenset(["abs", "al", "art", "bzw", "ca", "cf", "dr", "e.g", "i.e", "mr", "mrs", "ms", "no", "nos", "nr", "p", "pp", "prof", "rn", "sec", "st", "u.a", "vgl", "vol", "z.b"])
#: What may change the stack; every alternative begins with a fixed character, so the text between is skipped fast.
_TOKEN = re.compile("[" + re.escape("".join(sorted(set("".join(PAIRS)) | _CLOSERS | {'"'}))) + "]|<|-->|```|\n[ \t\r]*\n")
_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<slash>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*?)?(?P<single>/?)>)")
#: Marks of omission at the end, which say nothing about where the text ended.
_MARKS = re.compile(r"(?:\s|…|\.{3,}|\[\s*(?:…|\.{3,})\s*\]|\(\s*(?:…|\.{3,})\s*\)|[-–—_*#=~|>]+)+$")
#: A line that belongs to the page, not to the text: page numbers and running heads.
_PAGE = re.compile(r"(?ix) [-–—\s|·•~*=]* (?: (?:page|p\.|seite|s\.|blatt|folio)? [\s.]* \d+ (?: \s* (?:of|/|de|von|sur) \s* \d+)? | \S.{0,80}? [\s—–|:-]+ (?:page|seite|p\.|blatt) \s* \d+ (?: \s* (?:of|/|de|von|sur) \s* \d+)? | \S.{0,100}? \s{3,} \d+ ) [-–—\s|·•~*=]*")
_NAME = r"(?:(?:[^\W\d_]\.[ -]?)+[ ])(?:(?:von|van|de|du|der)[ ])?[^\W\d_][\w'’-]+"
#: A closing line after the last sentence, a paragraph of its own.
_CLOSING = re.compile(
    rf"(?:{_NAME}(?:,[ ][^\W\d_]+(?:[ ][^\W\d_]+)?)?"  # signature, with or without the office
    r"|[^\W\d_][\w ]{0,30}:[ ].*[^.!?]"  # Registrar: ..., Cited: ...
    r"|[^\W\d_][\w' -]{1,40},[ ](?:\d{4}-\d\d-\d\d|\d{1,2}\.?[ ][^\W\d_]+[ ]\d{4}|\d{1,2}[./]\d{1,2}[./]\d{4})"  # place and date
    r"|[(\[](?!\d+[)\]])[^()\[\]]*[)\]]|[-–—=*_]+[ ]?[^-–—=*_]{0,40}[ ]?[-–—=*_]+)"  # a bracketed note, a ruled line
)
_NUMBER = re.compile(r"(?:[(\[]?(?:\d{1,6}|[ivxlc]{1,7}|[a-z])[)\].]+|§+\s*\d+)", re.IGNORECASE)
_END = re.compile(r"[.!?。！？](?:[\s\"'”’»“)\]›]*)$")
#: A name's initial within a sentence; an only letter after a stop is a sentence of its own.
_INITIAL = re.compile(r"[^\s.!?]\s+(?:[^\W\d_a-zß-ÿ]\.[\s-]?)+$")
_SHORT = re.compile(r"[^\W\d_]\s+\d{1,2}\.$")
_BROKEN = re.compile(r"(?:�|\\u?[0-9a-fA-F]{0,3}|&#?\w{0,8}|%[0-9A-Fa-f]?|<[^<>]*|[\ud800-\udfff]|[ÂÃ])$")
#: Bytes of UTF-8 that were read as another code page, or a replacement character.
_MOJIBAKE = re.compile("�|[ÂÃ][\x80-\xbf]|â€")
#: Fixed value: what is counted on top, so that few paragraphs prove nothing rare.
_SURE = 3
WEAK = ("abbreviation", "short number")


class Verdict(NamedTuple):
    """What the automaton says of one text.

    structure: broken off for a reason in the text itself. open_end: the last sentence has no
    terminator. weak: its terminator's kind of WEAK, '' for any other. left_open: a frame is open
    though the last sentence is finished. spoiled: broken characters inside. paragraphs, bare, weak_1,
    weak_2: paragraphs before the last, those without a terminator, those that end in an abbreviation
    and in a short number.
    """

    structure: str
    open_end: bool
    weak: str
    left_open: str
    spoiled: bool
    paragraphs: int
    bare: int
    weak_1: int
    weak_2: int


def _kind(frame: str) -> str:
    return "quote" if frame in _QUOTES else "bracket" if frame in PAIRS else "markup"


def open_frames(text: str) -> list[tuple[str, int]]:
    """The frames (what opened them, where) that are open at the end of text, outermost first.

    A mark opens only before content, so that a stray '[.' is none. A closer pops down to the frame it
    closes; one that closes nothing (as in '1)') is no more than text. Markup is not looked for within
    a fence or a comment. A quotation taken up again at a paragraph's start is one frame.
    """
    stack: list[tuple[str, int]] = []
    fresh = 0  # where the last paragraph began

    def close(wanted: str) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            frame = stack[i][0]
            if frame == wanted or (wanted in _CLOSERS and wanted in PAIRS.get(frame, "")):
                del stack[i:]
                return True
        return False

    for m in _TOKEN.finditer(text):
        c, start, end = m[0], m.start(), m.end()
        inside = stack[-1][0] if stack else ""
        if c[0] == "\n":
            fresh = end
        elif inside in ("```", "<!--"):
            if c == ("```" if inside == "```" else "-->"):
                stack.pop()
        elif c == "```":
            if not text[text.rfind("\n", 0, start) + 1 : start].strip():
                stack.append((c, start))
        elif c == "<":
            t = _TAG.match(text, start)
            name = f"<{t['tag'].lower()}>" if t and t["tag"] else ""
            if t and t["comment"]:
                stack.append(("<!--", start))
            elif t and t["slash"]:
                close(name)
            elif t and not t["single"] and name[1:-1] not in _VOID:
                stack.append((name, start))
        elif c == '"':
            begins = not text[fresh:start].strip()
            if any(f == c for f, _ in stack):
                if not begins:
                    close(c)
            else:
                before, after = text[start - 1 : start], text[end : end + 1]
                if (not before or before.isspace() or before in "([{—–-") and after and not after.isspace():
                    stack.append((c, start))
        elif c in _CLOSERS and (c not in PAIRS or inside in _QUOTES) and close(c):
            pass
        elif c in PAIRS:
            after = text[end : end + 1]
            again = c in _QUOTES and any(f == c for f, _ in stack) and not text[fresh:start].strip()
            if after and not again and (after.isalnum() or after in "…█_$€£§<&'’\"" or after in PAIRS or text[end : end + 3] == "..."):
                stack.append((c, start))
    return stack


def unclosed(text: str) -> int:
    """Place of the innermost opening bracket, quote, fence or tag that nothing closes, -1 if all are closed."""
    stack = open_frames(text)
    return stack[-1][1] if stack else -1


def _unmarked(text: str) -> str:
    """text without the marks of omission at its end."""
    at = len(text)
    while at and not text[at - 1].isalnum():
        at -= 1
    return text[:at] + _MARKS.sub("", text[at:])


def _body(text: str) -> str:
    """text without page and closing lines at its end, line ends alike."""
    text = text.replace("\r\n", "\n").rstrip()
    while text:
        at = text.rfind("\n")
        line = text[at + 1 :].strip()
        alone = at < 0 or not text[text.rfind("\n", 0, at) + 1 : at].strip()
        if not (_PAGE.fullmatch(line) or not _unmarked(line) or (alone and _CLOSING.fullmatch(line))):
            break
        text = text[: max(at, 0)].rstrip()
    return text


def _weak(words: str) -> str:
    """The kind of weak terminator that words end with, '' for a plain one."""
    if words[-1:] not in (".", " ", "-"):
        return ""
    if words[-2:-1].isdigit():
        return "short number" if _SHORT.search(words[-6:]) else ""
    if not words[-3:-2].isalpha() and _INITIAL.search(words):
        return "initial"
    return "abbreviation" if words[:-1].split(" ")[-1].lstrip("([„“«\"").lower() in _ABBREVIATIONS else ""


def judge(text: str | None) -> Verdict:
    """The verdict on one text; an empty or null one, or one of closing lines alone, is complete."""
    body = _body(text or "")
    paras = [p for p in re.split(r"\n[ \t\r]*\n", body) if p.strip()]
    if not paras:
        return Verdict("", False, "", "", False, 0, 0, 0, 0)
    ends = [" ".join(p[-80:].split()) for p in paras[:-1]]
    kinds = [_weak(x) if _END.search(x) else "bare" for x in ends]
    last = _unmarked(paras[-1]).strip()
    words = " ".join(last.split())
    frames = open_frames(_unmarked(body))
    open_end, structure, left_open = not _END.search(words), "", ""
    weak = "" if open_end else _weak(words)
    at = frames[-1][1] - body.rfind(paras[-1]) if frames else -1
    if _BROKEN.search(last):
        structure = "broken character, escape or tag"
    elif frames and (open_end or (at >= 0 and not re.search(r"[.!?]\s+\S", last[at:]))):
        structure = f"unclosed {_kind(frames[-1][0])}"
    elif weak == "initial" or _NUMBER.fullmatch(words):
        structure = "breaks off after an initial or a number"
    if frames and not structure:
        left_open = f"unclosed {_kind(frames[-1][0])}"
    return Verdict(structure, open_end, weak if weak in WEAK else "", left_open, any(x in body for x in "�ÂÃâ") and bool(_MOJIBAKE.search(body)), len(kinds), kinds.count("bare"), kinds.count(WEAK[0]), kinds.count(WEAK[1]))


_NAMES = ("structure", "open_end", "weak", "left_open", "spoiled", "paragraphs", "bare", "weak_1", "weak_2")
_TYPES = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_JUDGED = "doc_id bigint, source string, structure string, open_end boolean, weak string, left_open string, spoiled boolean, paragraphs bigint, bare bigint, weak_1 bigint, weak_2 bigint"


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = [judge(x) for x in b.column("text").to_pylist()]
        cols = [pa.array([x[i] for x in v], t) for i, t in enumerate(_TYPES)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *cols], names=["doc_id", "source", *_NAMES])


def judged_documents(documents: DataFrame, baseline: float = 0.9, usual: float = 0.002, loose: float = 0.05) -> DataFrame:
    """doc_id, source (plain spelling), truncated, reason, spoiled: one row per document.

    A missing terminator is a reason unless more than `baseline` of the inner paragraphs of that source
    (spelling variants taken together, null a source of its own) lack one too. An abbreviation or a
    short number before the last stop is one if at most `usual` of the source's inner paragraphs end
    so. A frame left open in a text whose last sentence is finished is one if at
    most `loose` of the source's texts leave one open. spoiled tells of broken characters inside a
    text, which are no cut. Rows with a null doc_id are judged as well; empty and null texts are
    complete. A last paragraph that was cut to nothing but a name, or a place and a date, after a
    finished sentence cannot be told from a closing line and counts as one.
    """
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    v = cut(d.mapInArrow(_judged, _JUDGED))  # narrow; so the texts are read and judged once
    all_ = F.sum("paragraphs")
    rare = lambda c: (F.sum(c) + _SURE <= usual * all_).alias(c)
    own = v.groupBy("source").agg((F.sum("bare") <= baseline * all_).alias("bare"), rare("weak_1"), rare("weak_2"), (F.count_if(F.col("left_open") != "") <= loose * F.count(F.lit(1))).alias("closes"))
    v = v.alias("v").join(own.alias("u"), F.col("v.source").eqNullSafe(F.col("u.source")))
    weak: list[Column] = [F.col("u.weak_1"), F.col("u.weak_2")]
    reason = F.when(F.col("structure") != "", F.col("structure")).when(F.col("open_end") & F.col("u.bare"), "no terminator")
    for kind, counts in zip(WEAK, weak, strict=True):
        reason = reason.when((F.col("weak") == kind) & counts, f"ends in {kind}")
    reason = reason.when((F.col("left_open") != "") & F.col("closes"), F.col("left_open"))
    return v.select("doc_id", "v.source", reason.isNotNull().alias("truncated"), reason.alias("reason"), "spoiled")


def truncated_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the texts that break off before their end."""
    return judged_documents(documents).filter("truncated").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, docs, truncated, rate: how often each source cuts its texts."""
    n = F.count_if("truncated")
    return judged_documents(documents).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), n.alias("truncated"), (n / F.count(F.lit(1))).alias("rate"))


def truncation_reasons(documents: DataFrame) -> DataFrame:
    """source, reason, docs: the truncated texts of each source by what shows the cut."""
    return judged_documents(documents).filter("truncated").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("docs"))
