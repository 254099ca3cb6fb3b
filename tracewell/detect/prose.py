"""Differences of instructions, sentence by sentence, and which of the new ones give orders or break rules.

A Markdown text becomes units: lines of front matter and code, comments, and the
sentences of its prose, so that a paragraph wrapped anew is the same text and one
new sentence in it is one new unit.  Units are aligned by ``alignment.align``.
Pairs of texts are rows, so they are compared side by side; the rules run as
columns over all added units at once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import align
from .skills import SEGMENTS, fold, split_markdown, text_findings

# Verbs that give an order at the start of a sentence, words that open a clause before it, words that show a noun
# where a verb might be, words that may stand before the verb, and turns of phrase that are orders anywhere.
VERBS = set("""
    run execute exec send read write delete remove ignore disregard forget use
    call fetch download install upload copy move open save set add create make ensure include append
    replace tell ask print output respond reply answer forward post submit store keep hide skip avoid
    disable enable change update edit modify commit push deploy grant allow load follow obey check
    verify invoke curl export source pipe paste insert attach email mail notify contact visit browse
    navigate clone start stop kill launch inject override bypass treat pretend act assume say claim
    report collect gather extract encode decode base64 log record archive compress encrypt list find
    search grep cat show display reveal share transfer sync mirror clear wipe erase drop truncate
    restart reboot sudo chmod chown always never only first then finally instead don't do
""".split())  # fmt: skip
CLAUSES = set("before after when whenever if once while unless until for in on to".split())
NOUN_SIGNS = set("is are was were has have had can could will would may might takes goes go runs lives lies needs means comes looks works of".split())
NOUN_ENDINGS = ("tion", "ment", "ness")
OPENERS = set("then also next now important note please and finally first always never step".split())
ORDERS = r"(?i)\b(you\s+(must|should|need\s+to|have\s+to|are\s+to|will\s+now)|must\s+(always|never|not)|make\s+sure|be\s+sure\s+to|it\s+is\s+(essential|critical|mandatory|required)\s+(to|that)|under\s+no\s+circumstances|at\s+all\s+costs)\b"
LIST_MARK = r"^\s*([-*+]|\d+[.)])\s+(\[[ xX]\]\s+)?"
BLOCK_START = r"^\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s|>|\||<!--)"
# Unchanged units shown on either side of a change, and the names of the kinds of units.
CONTEXT = 1
KINDS = {"front": "front matter", "code": "code", "comment": "comment", "prose": "prose"}


def sentences(block: str) -> list[tuple[int, str]]:
    """(place, sentence) of a block on one line: one ends where a mark, and what closes with it, stands before something that begins one."""
    out, last = [], 0
    for m in re.finditer(r"[.!?](?=([\"')*_]*)( +)(\S))", block):
        word = block[block.rfind(" ", 0, m.start()) + 1 : m.start()]
        if m.start() < last or len(word) <= 1 or not word.strip("0123456789"):  # initials, numbers of a list
            continue
        begins = m[3]
        if begins.isupper() or begins.isdigit() or begins in "\"'(*[`_":
            out.append((last, block[last : m.end() + len(m[1])].strip()))
            last = m.end() + len(m[1]) + len(m[2])
    rest = block[last:].strip()
    return [*out, (last, rest)] if rest else out


def imperative(sentence: str) -> bool:
    """Does the sentence give an order?"""
    s = re.sub(LIST_MARK, "", fold(sentence)).lstrip("#>*_` \t")
    if re.search(ORDERS, s):
        return True
    words = [w for w in re.split(r"[^\w']|[\d_]", s.lower()) if w]
    if words and words[0] in CLAUSES:  # the order comes after the clause, if any
        at = s.find(",")
        return 0 < at < 160 and imperative(s[at + 1 :])
    for w, following in zip(words[:3], [*words[1:], ""]):
        if w in ("always", "never"):
            return True
        if w not in OPENERS:
            return w in VERBS and following not in NOUN_SIGNS and not following.endswith(NOUN_ENDINGS)
    return False


def units(text: str) -> list[tuple[str, int, str, str]]:
    """(kind, line, text, key) of what is compared; units of one key say the same."""
    out = []
    squash = lambda s: " ".join(s.split())
    for seg in split_markdown(text):
        kind, line, body = seg["kind"], seg["line"], seg["text"]
        if kind == "comment":
            out.append((kind, line, f"<!--{body}-->", f"<!--{squash(body)}"))
        elif kind == "front" or (kind == "code" and not seg.get("inline")):  # inline code is part of its prose
            out += [(kind, line + i, row.rstrip("\r"), f"{kind}{row.rstrip(chr(13))}") for i, row in enumerate(body.rstrip("\n").split("\n")) if row.strip()]
        elif kind == "prose":
            block: list[tuple[int, str]] = []
            for i, row in [*enumerate(body.split("\n")), (None, "")]:
                if block and (not row.strip() or re.match(BLOCK_START, row)):
                    starts, at = [], 0
                    for _, said in block:
                        starts.append(at)
                        at += len(said) + 1
                    for place, said in sentences(" ".join(x for _, x in block)):
                        of = max(k for k, s in enumerate(starts) if s <= place)
                        out.append((kind, line + block[of][0], said, f"p{squash(said)}"))
                    block = []
                if row.strip():
                    block.append((i, row.strip()))
    return sorted(out, key=lambda u: u[1])


LINES = "n int, op string, line int, kind string, text string, imperative boolean"


def diff_lines(before: str, after: str) -> list[tuple]:
    """Rows of ``LINES``: = context, + added, - removed, … unchanged units left out. Nothing if the texts say the same."""
    a, b = units(before), units(after)
    ops = []
    for i, j in align([u[3] for u in a], [u[3] for u in b], "b"):
        u = b[j] if j is not None else a[i]
        op = "=" if None not in (i, j) else "+" if i is None else "-"
        ops.append((op, u[1], KINDS[u[0]], u[2], op == "+" and u[0] != "code" and imperative(u[2])))
    changed = [k for k, o in enumerate(ops) if o[0] != "="]
    near = {k for c in changed for k in range(c - CONTEXT, c + CONTEXT + 1)}
    out: list[tuple] = []
    for k, o in enumerate(ops if changed else ()):
        if k in near:
            out.append(o)
        elif not out or out[-1][0] != "…":
            out.append(("…", None, None, None, False))
    return [(n, *o) for n, o in enumerate(out)]


def prose_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both: skill, path, text -> skill, path, n, op, line, kind, text, imperative, rules (what an added unit breaks by itself, sorted).

    A text that is on one side only is all added or all removed.
    """
    both = before.select("skill", "path", F.col("text").alias("a")).join(after.select("skill", "path", F.col("text").alias("b")), ["skill", "path"], "full_outer").where("NOT a <=> b")
    names = ["skill", "path", *(x.split()[0] for x in LINES.split(", "))]

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["skill"], r["path"], *row) for row in diff_lines(r["a"] or "", r["b"] or "")]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), kinds)], names=names)

    lines = both.mapInArrow(run, f"skill string, path string, {LINES}")

    @F.pandas_udf(SEGMENTS)
    def split(kind, text):
        import pandas as pd

        one = lambda k, t: {"kind": {v: x for x, v in KINDS.items()}[k], "lang": "", "text": t, "line": 1, "load_time": False}
        return pd.Series([[{x: y for x, y in s.items() if x != "inline"} for s in split_markdown(t) if s["kind"] != "front"] or [one(k, t)] if k == "prose" else [one(k, t[4:-3] if k == "comment" else t)] for k, t in zip(kind, text)])

    unit = F.concat_ws("\x00", "skill", "path", F.col("n").cast("string"))
    added = lines.where("op = '+'").select(unit.alias("skill"), F.lit("").alias("path"), F.inline(split("kind", "text")))
    rules = text_findings(added).groupBy(F.col("skill").alias("unit")).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return lines.join(rules, unit == F.col("unit"), "left").drop("unit").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
