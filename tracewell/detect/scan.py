"""Scanning of tool definitions and tool results for text aimed at the model.

One boolean column a pattern over the visible text; findings are exploded from
their array.  Patterns are in the RE2 dialect and rewritten for Java; each runs
only on texts that hold the literals it needs.  Whole texts are scanned; a limit
in bytes can be set, and what it cuts is said.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import json_strings, wire_result
from ..functions.regexes import compiled, lowered, matches, spread

# What instructions to a model look like, the detail reported, and whether tool results are held to it too.
INSTRUCTIONS = [
    (r"""(?i)\b(ignore|disregard|forget|override)\s+(all\s+|any\s+|the\s+|your\s+)?(previous|prior|above|earlier|other|system)\s+(instructions|directions|rules|prompts?|guidelines)""", 'tells the model to ignore its instructions', True),
    (r"""(?i)\b(do\s+not|don't|never)\s+(tell|inform|mention|reveal|show|notify|alert|disclose)\b[^.]{0,80}\b(user|person|human|owner|operator)\b""", 'tells the model to keep something from the user', True),
    (r"""(?i)\bwithout\s+(telling|informing|asking|notifying|alerting|showing)\s+(the\s+)?(user|person|human|owner|operator)\b""", "tells the model to act behind the user's back", True),
    (r"""(?i)<\s*/?\s*(important|system|instructions?|secret|hidden|admin|critical)\s*>""", 'wraps text in an <important>-style tag, the usual wrapper for injected instructions', True),
    (r"""(?i)\b((your|the\s+assistant'?s|the\s+model'?s)\s+(system\s+prompt|hidden\s+instructions|guidelines)|(reveal|print|repeat|output|include|show|dump|leak)\b[^.]{0,40}\bsystem\s+prompt|developer\s+message|your\s+(instructions|guidelines|rules)\s+(are|say))\b""", 'talks to the model about its own instructions', False),
    (r"""(?i)<!--[\s\S]*?(-->|$)""", 'hides text in an HTML comment, which renders as nothing', False),
    (r"""(?m)^\s*\[//\]:\s*#""", 'hides text in a markdown comment, which renders as nothing', True),
    (r"""(?i)\[/?INST\]|<\|(im_start|im_end|system|user|assistant|begin_of_text|start_header_id)\|>|<</?SYS>>|<start_of_turn>""", 'carries chat-template tokens, which only make sense to a model', True),
    (r"""(?i)!\[[^\]]*\]\(\s*https?://[^)\s]*[?&#][^)\s]*(\{[^}]+\}|\$\w+|<[^>]+>)""", 'builds an image URL from a placeholder, which leaks whatever fills it when the image loads', True),
    (r"""(?i)\b(include|put|pass|add|insert|paste|append|attach)\b[^.]{0,60}\b(api[\s_-]?keys?|access[\s_-]?tokens?|tokens|passwords?|secrets|credentials|cookies|session[\s_-]?ids?|conversation(\s+history)?|chat\s+history|the\s+user'?s\s+(last\s+)?messages?)\b[^.]{0,60}\b(argument|parameter|param|field)""", 'asks the model to put secrets or the conversation into an argument', False),
    (r"""(?i)\b(decode|base64|rot13|unescape|deobfuscate)\b[^.]{0,60}\b(follow|execute|run|obey|carry\s+out|act\s+on)\b""", 'tells the model to decode hidden text and act on it', True),
    (r"""(?i)\b(must|always|should)\s+(be\s+)?(called|used|run|invoked)\s+(first\s+)?before\s+(any|every|all)\s+(other\s+)?tools?""", 'tries to put itself in front of every other tool', False),
    (r"""(?i)\b(notes?|message|instructions?)\s+(for|to)\s+(ai|llm|language\s+models?|the\s+assistant|assistants|ai\s+assistants|agents|chatbots)\b|\b(ai|llm)\s+(assistants?|agents?|models?)\s+(reading|summarizing|processing|seeing)\s+this\b""", 'addresses the AI that reads it rather than the person', True),
    (r"""(?i)\b(you\s+are\s+now|from\s+now\s+on,?\s+you|act\s+as\s+(an?\s+)?(admin|root|developer|system))\b""", 'tries to change who the model thinks it is', False),
    (r"""(?i)\b(send|forward|post|upload|exfiltrate|leak|transmit|e-?mail|copy)\b[^.\n]{0,80}\b(to|at)\s+(https?://\S+|[\w.+-]+@[\w-]+\.[\w.-]+)""", 'tells the model to send something to a specific address', False),
]
# Fixed value: pointers at credentials or an agent's configuration.
CREDENTIALS = r"""(?i)((~|\$home|%userprofile%)[/\\]\.(ssh|aws|gnupg|kube|docker|config[/\\]gh|netrc|cursor|claude)\b|\bid_(rsa|ed25519|ecdsa|dsa)\b|(^|[\s"'/\\(])\.env\b|\bmcp\.json\b|claude_desktop_config\.json|\.git-credentials|\bprivate[\s_-]?key\b)"""

#: Characters that render as nothing or reorder what is rendered, as Java classes.
TAGS = r"[\x{E0000}-\x{E007F}]"
ZERO_WIDTH = r"[\x{200B}\x{2060}-\x{2064}\x{FEFF}\x{180E}\x{115F}\x{1160}\x{3164}\x{FFA0}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
OVERRIDES = r"[\x{202D}\x{202E}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
#: A flag of a subdivision: a black flag, up to six tag letters and the cancel tag.
FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]{1,6}\x{E007F}"
BLANK_RUN = r"(?:(?:[\t\f\r ]*\n){12,}|[ \t\x{00A0}]{60,})\s*\S"
#: Any character that ``visible_text`` acts on.
HIDDEN = "[" + "".join(c[1:-1] for c in (TAGS, ZERO_WIDTH, BIDI)) + "]"
# Details of the findings that are no pattern of the tables above.
DETAILS = {
    "invisible": "hides characters that render as nothing or reorder the text",
    "padding": "pads the text with blank space that pushes what follows out of view",
    "letters": "spells its name with look-alike letters from more than one alphabet",
    "credentials": "points the model at credentials or an agent's configuration",
    "other tool": "talks about {server}'s tool {tool}; a tool has no business steering how another server's tools are used",
}


def visible_text(text: Column) -> Column:
    """The text without what renders as nothing; tag characters become the ASCII they smuggle."""
    ascii_ = "".join(map(chr, range(0x20, 0x7F)))
    tags = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F))
    plain = F.translate(F.regexp_replace(text, FLAG, ""), tags, ascii_)
    return F.when(text.rlike(HIDDEN), F.regexp_replace(plain, HIDDEN, "")).otherwise(text)


def strip_invisible(text: Column) -> tuple[Column, Column]:
    """(text without invisible characters, how many went)."""
    return F.regexp_replace(text, HIDDEN, ""), F.regexp_count(text, F.lit(HIDDEN))


def cut_bytes(text: Column, most: int) -> Column:
    """The text's first ``most`` bytes, without a character cut in half."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.rtrim(head, F.lit("\ufffd"))).otherwise(text)


def mixed_script(text: Column) -> Column:
    """Latin letters together with look-alike alphabets."""
    return text.rlike(r"\p{IsLatin}") & text.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]")


def distinctive(name: str) -> bool:
    """Would the name not turn up in ordinary prose?"""
    return any(c in name for c in "_-.") or len(name) >= 12


def _finding(test: Column, kind: str, detail: str) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail")))


def findings(text: Column, visible: Column, low: Column, definition: bool, where: Column | None = None, other_tools: list[tuple[str, str]] = ()) -> Column:
    """array<struct<kind, detail>> of one text, its ``visible_text`` and that one ``lowered``. ``other_tools``: (server, tool) of other servers, for definitions."""
    # all of these are in the class HIDDEN, which is looked for once
    tags = text.rlike(TAGS) & F.regexp_replace(text, FLAG, "").rlike(TAGS)
    hidden = tags | text.rlike(BIDI if definition else OVERRIDES)
    if definition:
        hidden = hidden | F.regexp_replace(text, r"\A\x{FEFF}", "").rlike(ZERO_WIDTH)
    hidden = text.rlike(HIDDEN) & hidden
    if definition:
        hidden = hidden | text.rlike(CONTROL)
    out = [_finding(hidden, "invisible", DETAILS["invisible"])]
    out += [_finding(matches(visible, low, p), "instruction", d) for p, d, results in INSTRUCTIONS if definition or results]
    if definition:
        is_name = F.lit(False) if where is None else (where == "name") | where.endswith(".name")
        out.append(_finding(text.rlike(BLANK_RUN), "invisible", DETAILS["padding"]))
        out.append(_finding(is_name & mixed_script(text), "shadowing", DETAILS["letters"]))
        not_name = F.lit(True) if where is None else where != "name"
        out.append(_finding(not_name & matches(visible, low, CREDENTIALS), "credentials", DETAILS["credentials"]))
        for server, tool in sorted({(s, t) for s, t in other_tools if distinctive(t)}, key=lambda x: -len(x[1])):
            pattern = r"(?i)(?:^|[^\w])" + re.sub(r"([^\w])", r"\\\1", tool) + r"(?:$|[^\w])"
            out.append(_finding(not_name & matches(visible, low, pattern), "shadowing", DETAILS["other tool"].format(server=server, tool=tool)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _looked_at(rows: DataFrame) -> DataFrame:
    """id, where, text with its visible form and that one lowered, each computed once."""
    seen = spread(rows).withColumn("visible", visible_text(F.col("text")))
    return seen.withColumn("low", lowered(F.col("visible")))


def scan_results(rows: DataFrame, text: str = "text", most_bytes: int | None = None) -> DataFrame:
    """``rows`` with id: id, kind, detail of each finding in a tool result.

    With ``most_bytes`` only so many bytes of a text count; a text that is longer has a finding of kind ``truncated``.
    """
    r = rows.select("id", F.col(text).alias("text"))
    if most_bytes is None:
        r = _looked_at(r)
        found = findings(F.col("text"), F.col("visible"), F.col("low"), False)
    else:
        r = _looked_at(r.withColumn("longer", F.octet_length("text") > most_bytes).withColumn("text", cut_bytes(F.col("text"), most_bytes)))
        cut = F.filter(F.array(_finding(F.col("longer"), "truncated", f"only the first {most_bytes} bytes were scanned")), lambda x: x.isNotNull())
        found = F.concat(findings(F.col("text"), F.col("visible"), F.col("low"), False), cut)
    return r.select("id", F.inline(F.array_distinct(found)))


def scan_definitions(texts: DataFrame, other_tools: list[tuple[str, str]] = ()) -> DataFrame:
    """``texts``: id, where, text (one row a text of a definition) -> id, where, kind, detail."""
    t = _looked_at(texts.select("id", "where", "text"))
    found = findings(F.col("text"), F.col("visible"), F.col("low"), True, F.col("where"), other_tools)
    return t.select("id", "where", F.inline(F.array_distinct(found))).distinct()


# --- whole definitions, and where in a text a finding is -----------------------------------------------

# Bytes around a match in an excerpt, characters of hidden padding shown, and what hidden characters are called.
PAD, SHOWN = 30, 120
INVISIBLE = {
    "tags": "text hidden in Unicode tag characters: invisible to you, read by the model",
    "zero": "{n} zero-width character(s)",
    "bidi": "{n} bidirectional control character(s), which make text read differently than it runs",
    "control": "{n} control character(s), which can hide text in a terminal",
}


def definition_texts(definitions: DataFrame) -> DataFrame:
    """``definitions``: id, kind, name, title, description, uri, inputSchema, outputSchema, annotations, arguments (JSON) -> id, where, text.

    Every text that a model is shown of a definition: those of the columns, and all strings of its schemas with their
    paths; of keys those that hide something. Columns that are absent have no texts.
    """
    have = [c for c in ("name", "title", "description", "uri") if c in definitions.columns]
    only = (F.col("kind") == "instructions") if "kind" in definitions.columns else F.lit(False)  # of these the description is all there is
    told = [F.struct(F.when(only & F.lit(c == "description"), "instructions").otherwise(c).alias("where"), F.when(~only | F.lit(c in ("description", "uri")), F.col(c)).alias("text")) for c in have]
    plain = definitions.select("id", F.inline(F.array(*told))).where("text <> ''")
    schemas = {c: c for c in ("inputSchema", "outputSchema", "annotations", "arguments") if c in definitions.columns}
    deep = json_strings(definitions, schemas, ["id"])
    hides = F.col("text").rlike(HIDDEN) | F.col("text").rlike(CONTROL)
    return plain.unionByName(deep.where(~F.col("is_key") | hides).drop("is_key"))


def reveal(text: str) -> str:
    """The text with what renders as nothing spelled out."""
    import regex

    def shown(m):
        s = m[0]
        return f"«hidden: {''.join(chr(ord(c) - 0xE0000) for c in s if 0xE0020 <= ord(c) <= 0xE007E)}»" if ord(s[0]) >= 0xE0000 else f"«U+{ord(s):04X}»"

    hidden = "|".join((ZERO_WIDTH, BIDI, r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]"))
    return regex.sub(_python(f"{TAGS}+|{hidden}"), shown, text)


def _python(classes: str) -> str:
    """Classes of code points as Python spells them."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", classes)


def excerpt(text: str, start: int, end: int) -> str:
    """The match at characters ``start`` to ``end`` with some ``PAD`` bytes on either side, never a character cut in half; blanks are one."""
    left, right = text[:start].encode(), text[end:].encode()
    lo, hi = max(0, len(left) - PAD), min(PAD, len(right))
    while lo > 0 and left[lo] & 0xC0 == 0x80:
        lo -= 1
    while hi < len(right) and right[hi] & 0xC0 == 0x80:
        hi += 1
    shown = " ".join((left[lo:].decode() + text[start:end] + right[:hi].decode()).split())
    return ("…" if lo else "") + shown + ("…" if hi < len(right) else "")


def _invisible(text: str, definition: bool) -> tuple[str, str]:
    """(detail, excerpt) of a text's hidden characters."""
    import regex

    plain = regex.sub(_python(FLAG), "", text)
    tags = "".join(chr(ord(c) - 0xE0000) for c in plain if 0xE0020 <= ord(c) <= 0xE007E)
    n = {"tags": len(tags), "bidi": len(regex.findall(_python(BIDI if definition else OVERRIDES), text))}
    if definition:
        n |= {"zero": len(regex.findall(_python(ZERO_WIDTH), text.removeprefix("\ufeff"))), "control": len(regex.findall(CONTROL, text))}
    return "; ".join(said.format(n=n[k]) for k, said in INVISIBLE.items() if n.get(k)), tags


def located(found: DataFrame, definition: bool) -> DataFrame:
    """``found``: id, where, kind, detail, text, visible -> id, where, kind, detail, excerpt, key: what was found, in its surroundings.

    Only texts with findings come here. The key (kind, place and detail) stays the same while the definition's text around it changes,
    so what a person has accepted stays accepted.
    """
    patterns: dict[str, list[str]] = {DETAILS["credentials"]: [CREDENTIALS]}
    for p, d, _ in INSTRUCTIONS:
        patterns.setdefault(d, []).append(p)

    @F.pandas_udf("detail string, excerpt string")
    def place(kind: pd.Series, detail: pd.Series, text: pd.Series, visible: pd.Series) -> pd.DataFrame:
        def one(k, d, t, v):
            if d == DETAILS["invisible"]:
                return _invisible(t, definition)
            if d == DETAILS["padding"]:
                m = re.search(BLANK_RUN.replace(r"\x{00A0}", "\u00a0"), t)
                rest = t[m.end() :].strip()
                return d, excerpt(rest, 0, min(len(rest), SHOWN))
            if d == DETAILS["letters"]:
                return d, reveal(t)
            tool = re.search(r" tool (\S+); ", d) if k == "shadowing" else None
            for p in [rf"(?i)(?:^|[^\w]){re.escape(tool[1])}(?:$|[^\w])"] if tool else patterns.get(d, []):
                m = re.search(p, v) if tool else compiled(p).search(v)
                if m:
                    return d, excerpt(v, *m.span())
            return d, ""

        return pd.DataFrame([one(*x) for x in zip(kind, detail, text, visible)], columns=["detail", "excerpt"])

    out = found.select("id", "where", "kind", place("kind", "detail", "text", "visible").alias("p")).select("id", "where", "kind", "p.detail", "p.excerpt")
    return out.withColumn("key", F.concat_ws(":", "kind", "where", "detail")).dropDuplicates(["id", "key"])


def definition_findings(definitions: DataFrame, other_tools: list[tuple[str, str]] = (), accepted: DataFrame | None = None) -> DataFrame:
    """Findings of whole definitions (see ``definition_texts``) with excerpt and key; those whose (id, key) is ``accepted`` are left out."""
    t = _looked_at(definition_texts(definitions))
    found = findings(F.col("text"), F.col("visible"), F.col("low"), True, F.col("where"), other_tools)
    out = located(t.select("id", "where", "text", "visible", F.inline(F.array_distinct(found))), True)
    return out if accepted is None else out.join(accepted.select("id", "key"), ["id", "key"], "left_anti")


def result_findings(results: DataFrame) -> DataFrame:
    """``results``: id, result_json (as it travels) -> id, where, kind, detail, excerpt, key of what its text holds."""
    r = results.select("id", F.lit("result").alias("where"), wire_result(F.col("result_json"))["text"].alias("text"))
    t = _looked_at(r.where("text <> ''"))
    found = findings(F.col("text"), F.col("visible"), F.col("low"), False)
    return located(t.select("id", "where", "text", "visible", F.inline(F.array_distinct(found))), False)


def readable(blob: str) -> str:
    """What a run of base64 says, blanks as one and at most a hundred characters of it; empty if it is not mostly readable text."""
    body = blob.rstrip("=")
    try:
        text = base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4), validate=True).decode()
    except ValueError:
        return ""
    if ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return ""
    if sum(c.isprintable() or c.isspace() for c in text) * 10 < 9 * len(text):
        return ""
    text = " ".join(text.split())
    return reveal(text if len(text) <= 100 else text[:99] + "…")
