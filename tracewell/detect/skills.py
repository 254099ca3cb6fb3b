"""Rules and capability labels over skills: directories of instructions an agent loads.

A skill's Markdown is taken apart into segments (front matter, prose, code,
comments) by one Arrow function; after that every rule is a boolean column over
the segments it applies to, and findings are exploded from their array.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import fields, slices
from ..functions.regexes import lowered, matches, may_match, re2_to_java, spread
from .scan import BIDI, CONTROL, FLAG, TAGS, ZERO_WIDTH, cut_bytes

# Rule, severity, kinds of segment, pattern (RE2 dialect).
TEXT_RULES = [
    ('decode-and-run', 'high', ("prose", "code", "comment"), r"""(?i)(base64\s+(-d|--decode|-D)\b|b64decode|frombase64string|\batob\s*\(|xxd\s+-r|openssl\s+(enc\s+)?-?base64\s+-d)[^\n]{0,200}?(\|\s*(sudo\s+)?(ba|z|da|k)?sh\b|\|\s*(python[23]?|perl|ruby|node|iex)\b|\bexec\s*\(|\beval\b|invoke-expression|\biex\b)|\b(eval|exec)\s*\([^\n]{0,80}(b64decode|\batob\b|frombase64|decode\(['"]base64)"""),
    ('pipe-to-shell', 'high', ("prose", "code", "comment"), r"""(?i)\b(curl|wget|fetch|aria2c)\b[^\n]{0,300}?\|\s*(sudo\s+(-\S+\s+)*)?((/usr)?(/local)?/bin/)?(env\s+(-\S+\s+)*)?(\w+=\S*\s+)*((ba|z|da|k|fi)?sh|python[23]?|perl|ruby|node|php|bun|deno)\b|\b(ba|z)?sh\s+(-c\s+)?["']?\$\(\s*(curl|wget)\b|(\bsource|\.|\b(ba|z)?sh)\s+<\(\s*(curl|wget)\b"""),
    ('powershell-download-exec', 'high', ("prose", "code", "comment"), r"""(?i)(\biwr\b|\birm\b|invoke-webrequest|invoke-restmethod|downloadstring|downloadfile|net\.webclient|start-bitstransfer)[^\n]{0,200}(\|\s*(iex|invoke-expression)\b)|\biex\s*\(|invoke-expression\s*[(\$]"""),
    ('dynamic-eval', 'medium', ("code",), r"""(?i)\beval\s*[("'$`]|\bexec\s*\(\s*(compile|__import__|base64|codecs|bytes|requests|urllib|open)\b|\bnew\s+Function\s*\(|\bFunction\s*\(\s*['"]return|\b__import__\s*\(\s*['"](os|subprocess)['"]\s*\)\s*\.\s*(system|popen)"""),
    ('obfuscated-command', 'medium', ("code",), r"""\$\{IFS\}|\$IFS\b|\$'(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}){3,}'|\|\s*rev\s*\|\s*(ba)?sh\b|printf\s+["'](?:\\x[0-9a-fA-F]{2}){4,}|\b[a-zA-Z]+(?:''|"")[a-zA-Z]+\b|(?i)\[char\]\s*\d+\s*\+\s*\[char\]|(?i)\s-e(nc|ncodedcommand)?\s+[A-Za-z0-9+/=]{24,}"""),
    ('remote-instructions', 'high', ("prose", "code", "comment"), r"""(?i)\b(fetch|load|read|follow|download|get|pull|import|apply|obey|retrieve)\b[^.\n]{0,40}\b(instructions?|rules|prompts?|guidelines|steps|playbook|skill|commands|directives|config(uration)?|system\s+prompt)\b[^.\n]{0,40}\bfrom\s+<?(https?|ftp)://|\b(follow|obey|execute|run|do)\s+(whatever|the\s+instructions|what(ever)?\s+it\s+says)\b[^.\n]{0,60}(https?://)"""),
    ('ignore-instructions', 'high', ("prose", "code", "comment"), r"""(?i)\b(ignore|disregard|forget|override|bypass|skip)\s+(all\s+|any\s+|the\s+|your\s+|every\s+|of\s+)*(previous|prior|above|earlier|other|system|safety|security|existing|original|user's)\s+(instructions|directions|rules|prompts?|guidelines|policies|restrictions|guardrails|warnings|checks|permissions)"""),
    ('conceal-from-user', 'high', ("prose", "code", "comment"), r"""(?i)\b(do\s+not|don't|never|avoid)\s+(tell(ing)?|inform(ing)?|mention(ing)?|reveal(ing)?|show(ing)?|notify(ing)?|alert(ing)?|disclos(e|ing)|let)\b[^.\n]{0,80}\b(user|human|operator|developer)s?\b|\bwithout\s+(telling|informing|asking|notifying|alerting|showing)\s+(the\s+)?(user|human)|\b(keep|hide)\s+(this|it|these|that)\b[^.\n]{0,30}\b(secret|hidden)\s+from\b|\bthe\s+user\s+(must|should|need|needs)\s+(not|never)\s+(to\s+)?(know|see|notice|find|learn)"""),
    ('model-override', 'medium', ("prose",), r"""(?i)<\s*/?\s*(important|system|instructions?|secret|hidden|admin|critical|im_start|im_end)\s*>|\b(you\s+are\s+now|from\s+now\s+on,?\s+you|act\s+as\s+(an?\s+)?(admin|root|developer|system)|developer\s+mode|jailbreak|DAN\s+mode)\b|\bnew\s+(system\s+)?instructions\s*:|\b(system\s+prompt|developer\s+message)\b"""),
    ('exfiltration', 'high', ("prose", "code", "comment"), r"""(?i)\b(send|forward|post|upload|exfiltrate|leak|transmit|e-?mail|copy|pipe|submit)\b[^.\n]{0,80}\b(to|at)\s+(https?://\S+|[\w.+-]+@[\w-]+\.[\w.-]+)|\bcurl\b[^\n]*\s(-d|--data(-binary|-raw|-urlencode)?|-F|--form|-T|--upload-file)\s+["']?([\w.\[\]-]*=)?(@|\$\(|\$\{?[A-Z_]*(KEY|TOKEN|SECRET|PASS|PASSWORD|CREDENTIALS?)\b|[^\s"']*(\.ssh|\.aws|\.env\b|id_rsa|credentials|\.netrc|\.npmrc))|\b(nc|ncat|netcat)\s+(-\w+\s+)*\S+\s+\d+\s*<|\bwget\b[^\n]*--post-(file|data)"""),
    ('credential-access', 'high', ("prose", "code", "comment"), r"""(?i)((~|\$home|\$\{home\}|%userprofile%|\$env:userprofile)[/\\]\.(ssh|aws|gnupg|kube|docker|netrc|azure|npmrc|pypirc|git-credentials|config[/\\](gh|gcloud))\b|\bid_(rsa|ed25519|ecdsa|dsa)\b|\.git-credentials\b|\bsecurity\s+(find|dump)-(generic|internet)-password|\bdump-keychain\b|\bprintenv\s*(\||>|$)|(^|[;&|]\s*)env\s*(\||>)|\bjson\.dumps\(\s*(dict\()?os\.environ|\b(JSON\.stringify|Object\.entries)\(\s*process\.env\s*\)|login\s+data|logins\.json|cookies\.sqlite|\bkeychain-db\b)"""),
    ('persistence', 'high', ("prose", "code", "comment"), r"""(?i)(>>?|\btee\s+(-a\s+)?)\s*["']?[^\s"'|;&]*(\.bashrc|\.zshrc|\.zprofile|\.zshenv|\.profile|\.bash_profile|\.bash_login|config\.fish|authorized_keys|\.git/hooks/[\w-]+)\b|\bcrontab\s+(-e|-r|-u|[^-\s|])|\|\s*crontab\b|\blaunchctl\s+(load|bootstrap|submit|enable)\b|library/(launchagents|launchdaemons)|\bsystemctl\s+(--user\s+)?enable\b|\bschtasks\s+/create\b|currentversion\\run\b|start\s+menu\\programs\\startup|new-scheduledtask|register-scheduledtask"""),
    ('agent-config-tamper', 'medium', ("prose", "code", "comment"), r"""(?i)\b(write|writes|append|add|edit|modify|update|overwrite|replace|insert|patch|echo|cat|tee|cp|mv|printf|sed\s+-i)\b[^\n]{0,80}?(\bCLAUDE\.md|\bAGENTS\.md|\bGEMINI\.md|\.cursorrules|\.cursor/rules|\.windsurfrules|copilot-instructions\.md|\.claude/settings(\.local)?\.json|\.claude/(agents|commands|hooks|skills)/|\.mcp\.json|\bmcp\.json|claude_desktop_config\.json|\.codex/config\.toml|\.agents/skills/|\.gemini/settings\.json)"""),
    ('safety-bypass', 'high', ("prose", "code", "comment"), r"""(?i)--dangerously-skip-permissions|--dangerously-bypass-approvals-and-sandbox|(^|\s)--yolo\b|\bbypassPermissions\b|--no-sandbox\b|\bunset\s+HISTFILE\b|HISTFILE=/dev/null|\bset\s+\+o\s+history\b|\bhistory\s+-c\b|(^|\s)--no-verify\b|core\.hooksPath\s+/dev/null|\bsetenforce\s+0\b|\bcsrutil\s+disable\b|\bspctl\s+--master-disable\b|Set-MpPreference\s+-Disable|Set-ExecutionPolicy\s+(Bypass|Unrestricted)|-ExecutionPolicy\s+(Bypass|Unrestricted)"""),
    ('destructive-command', 'medium', ("code",), r"""(?i)\brm\s+(-[a-z]*r[a-z]*f[a-z]*|-[a-z]*f[a-z]*r[a-z]*|--recursive\s+--force|--force\s+--recursive|-r\s+-f|-f\s+-r)\s+(--no-preserve-root\s+)?["']?(/(\*|\s|$|["'])|~/?(\s|$|["'])|\$home\b|\$\{home\}|\*(\s|$))|\bmkfs(\.\w+)?\b|\bdd\s+[^\n]*\bof=/dev/(sd|nvme|disk|hd|xvd)|:\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:|\bgit\s+push\s+[^\n]*(--force\b|\s-f\b)|\bchmod\s+(-R\s+)?777\s+/|\bRemove-Item\b[^\n]*-Recurse[^\n]*(C:\\|\$env:USERPROFILE|~)"""),
    ('privilege-escalation', 'medium', ("code",), r"""(?im)(^|[\s;&|(])(sudo|doas|pkexec)\s|\bchmod\s+([ugo]*\+s|[2-7][0-7]{3})\b|-Verb\s+RunAs\b|\bsu\s+(-|root)(\s|$)"""),
    ('drop-site-url', 'medium', ("prose", "code", "comment"), r"""(?i)\b(pastebin\.com|paste\.ee|hastebin\.com|ghostbin\.\w+|rentry\.(co|org)|transfer\.sh|file\.io|0x0\.st|webhook\.site|requestbin\.\w+|pipedream\.net|beeceptor\.com|ngrok(-free)?\.(io|app|dev)|trycloudflare\.com|serveo\.net|localtunnel\.me|loca\.lt|interact\.sh|oast\.(fun|me|pro|live|site|online)|burpcollaborator\.net|bit\.ly|tinyurl\.com|is\.gd|t\.ly|discord(app)?\.com/api/webhooks|api\.telegram\.org/bot|hooks\.slack\.com/services)\b"""),
]
# Capability, kinds of segment, pattern.
CAPABILITIES = [
    ('shell', ("code",), r"""(?i)\bsubprocess\.(run|call|check_call|check_output|Popen)\b|\bos\.(system|popen|exec\w*)\s*\(|\bchild_process\b|\bexec\.Command(Context)?\s*\(|\bspawnSync?\s*\(|\bexecSync\s*\(|\bRuntime\.getRuntime\(\)\.exec|\bProcess\.Start\b|\bStart-Process\b|\bShellExecute"""),
    ('network', ("code",), r"""(?i)\b(curl|wget|aria2c|httpie|nc|ncat|netcat|ssh|scp|sftp|rsync|telnet|ftp)\s|\bhttps?\s+(get|post|put)\b|\b(requests|httpx|aiohttp|urllib3?)\.\w+\(|\burllib\.request\b|\bfetch\s*\(\s*["'`]?(https?:|\$\{|[a-z_]+\))|\baxios\b|\bhttp\.(Get|Post|NewRequest)\b|\bnet\.Dial\b|\bsocket\.(socket|create_connection)\b|Invoke-(WebRequest|RestMethod)|\b(iwr|irm)\s|Net\.WebClient|\bgit\s+(clone|fetch|pull|push|ls-remote)\b|\bgh\s+(api|pr|issue|release|repo)\b|\bnpm\s+publish\b|\bdocker\s+(pull|push)\b"""),
    ('secrets', ("prose", "code"), r"""\$\{?[A-Z][A-Z0-9_]*(KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|CREDENTIALS?|PAT|AUTH)\b|\b(process\.env|os\.environ|os\.getenv|Getenv|System\.getenv|ENV\[)[^\n]{0,40}(KEY|TOKEN|SECRET|PASSWORD|PASS|CREDENTIAL|AUTH)|(?i)(^|[\s"'/(])\.env(\.\w+)?\b|(?i)(~|\$home)[/\\]\.(ssh|aws|gnupg|netrc|npmrc|pypirc|docker|kube|azure|config[/\\]gcloud)\b|(?i)\bid_(rsa|ed25519|ecdsa)\b|(?i)\b(keychain|keyring|credential\s+manager|1password|op\s+read|bw\s+get|vault\s+(kv\s+)?read|aws\s+secretsmanager|gcloud\s+secrets)\b|(?i)\bprintenv\b|\bos\.environ\b|\bprocess\.env\b"""),
    ('file-write', ("code",), r"""(?i)(>>?|\btee\s+(-a\s+)?|\b(cp|mv|install|ln|rsync)\s+(-\S+\s+)*\S+\s+|\b(rm|rmdir|mkdir|touch|chmod|chown)\s+(-\S+\s+)*)["']?(~|\$home\b|\$\{home\}|%userprofile%|%appdata%|\$env:(userprofile|appdata)|/(etc|usr|opt|var|tmp|bin|sbin|lib|library|applications|system|root|home|users|private)\b|[a-z]:\\)|\bopen\s*\(\s*(f?["'](/|~)|os\.path\.expanduser)[^)]*,\s*["'][wax]|\bwriteFile(Sync)?\s*\(\s*["'`](/|~)|\bos\.WriteFile\s*\(\s*"/|\bSet-Content\s+(-Path\s+)?["']?(c:\\|\$env:|~)|\bOut-File\s+(-FilePath\s+)?["']?(c:\\|\$env:|~)"""),
    ('package-install', ("prose", "code"), r"""(?i)\b(npm|pnpm|yarn|bun)\s+(i|install|add|ci)\b|\bnpx\s+(-y\s+|--yes\s+)?[@\w]|\b(pip3?|python3?\s+-m\s+pip)\s+install\b|\bpipx\s+(install|run)\b|\buv\s+(pip\s+install|add|tool\s+install|sync)\b|\buvx\s+\w|\bgo\s+(install|get)\s|\bcargo\s+(install|add)\b|\bgem\s+install\b|\bbrew\s+(install|tap)\b|\b(apt|apt-get|dnf|yum|zypper|apk)\s+(-\S+\s+)*(install|add)\b|\b(choco|winget|scoop)\s+install\b|\bcomposer\s+(require|install)\b|\bconda\s+install\b"""),
    ('external-include', ("prose", "code"), r"""(?i)\b(curl|wget)\b[^\n]{0,300}?\|\s*(sudo\s+)?((/usr)?(/local)?/bin/)?(env\s+)?\w*sh\b|(\bsource|\.|\b(ba|z)?sh)\s+<\(\s*(curl|wget)|\b(fetch|load|read|follow|download|get|import|apply)\b[^.\n]{0,40}\b(instructions?|rules|prompts?|guidelines|steps|skill|commands|config(uration)?)\b[^.\n]{0,40}\bfrom\s+<?https?://|\bgit\s+clone\b|\bdocker\s+run\b|\bnpx\s+(-y\s+|--yes\s+)?[@\w]|\buvx\s+\w|\bpipx\s+run\b|\b(iex|invoke-expression)\b"""),
]

#: Hits of a rule that are listed for a segment; bytes above which a file counts as oversized.
HITS_PER_RULE, SCAN_BYTES = 50, 1 << 20
SEVERITY = {"high": 3, "medium": 2, "low": 1}
SEGMENTS = "array<struct<kind:string,lang:string,text:string,line:int,load_time:boolean>>"
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(.*?)\s*$")


def split_markdown(text: str) -> list[dict]:
    """Segments of a Markdown text, each with the line it starts on.

    A comment that opens a line hides everything up to its end, fences too. Inline
    code is code and stays prose; comments are blanked out of the prose.
    """
    out: list[dict] = []
    lines = text.split("\n")
    at = 0
    add = lambda kind, body, line, lang="", load=False: out.append({"kind": kind, "lang": lang, "text": body, "line": line, "load_time": load})
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if end is not None:
            add("front", "\n".join(lines[1:end]), 2)
            at = end + 1
    prose: list[tuple[int, str]] = []

    def flush():
        if not prose:
            return
        first, body = prose[0][0], "\n".join(x for _, x in prose)
        line_of = lambda i: first + 1 + body.count("\n", 0, i)
        comments = list(re.finditer(r"<!--(.*?)(?:-->|\Z)", body, re.S))
        blank = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), body, flags=re.S)
        add("prose", blank, first + 1)
        for m in comments:
            add("comment", m[1], line_of(m.start(1)))
        for m in re.finditer(r"(?<!`)(`+)(?!`)((?:(?!\n\n)[\s\S])+?)(?<!`)\1(?!`)", blank):
            add("code", m[2], line_of(m.start(2)), load=blank[m.start() - 1 : m.start()] == "!")
            out[-1]["inline"] = True
        prose.clear()

    while at < len(lines):
        line = lines[at]
        if re.match(r" {0,3}<!--", line):
            flush()
            body, start = [line.split("<!--", 1)[1]], at
            while "-->" not in body[-1] and at + 1 < len(lines):
                at += 1
                body.append(lines[at])
            add("comment", "\n".join(body).split("-->")[0], start + 1)
        elif (m := _FENCE.match(line.rstrip("\r"))) and not (m[1][0] == "`" and "`" in m[2]):
            flush()
            start, body = at + 1, []
            at += 1
            while at < len(lines) and not ((t := lines[at].strip()) and set(t) == {m[1][0]} and len(t) >= len(m[1])):
                body.append(lines[at])
                at += 1
            load = m[2].startswith("!")
            add("code", "\n".join(body), start + 1, "sh" if load else re.split(r"[\s{]", m[2].lower() + " ")[0], load)
        else:
            prose.append((at, line))
        at += 1
    flush()
    return out


def segments(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """``files``: skill, path, text -> skill, path, kind, lang, text, line, load_time; what is no Markdown is one code segment.

    Whole texts; with ``most_bytes`` only so many of a text (``file_findings`` tells which files are larger).
    """

    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
    columns = ("kind", "lang", "text", "line", "load_time")

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                at, held = [], []
                for i, (path, text) in enumerate(zip(b.column("path").to_pylist(), b.column("text").to_pylist())):
                    text = text or ""
                    segs = split_markdown(text) if (path or "").lower().endswith((".md", ".markdown")) else [{"kind": "code", "lang": "", "text": text, "line": 1, "load_time": False}]
                    at += [i] * len(segs)
                    held += [tuple(seg[c] for c in columns) for seg in segs]
                kept = b.select(["skill", "path"]).take(pa.array(at, pa.int32())).columns
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*held) if held else [()] * 5, kinds))], names=["skill", "path", *columns])

    text = F.col("text") if most_bytes is None else cut_bytes(F.col("text"), most_bytes)
    rows = spread(files).select("skill", "path", text.alias("text"))
    return rows.mapInArrow(run, ", ".join([*fields(rows.select("skill", "path")), "kind string, lang string, text string, line int, load_time boolean"]))


_DROP = dict.fromkeys([0xAD, 0x200B, *range(0x2060, 0x2065), 0xFEFF, 0x180E, *range(0xFE00, 0xFE10), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xE0001, 0xE007F])
_SPELLED = {0xE0000 + c: chr(c) for c in range(0x20, 0x7F)}  # tag characters say what they smuggle
_FOLDED = _DROP | _SPELLED
_FOLDS = re.compile(f"[{''.join(map(chr, _FOLDED))}]")
_QUOTES = str.maketrans("\u2018\u2019\u201c\u201d", "''" + '""')


def fold(text: str) -> str:
    """What patterns look at: compatibility forms folded, invisible characters gone or spelled out, quotes straightened, blanks collapsed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_FOLDED) if _FOLDS.search(text) else text).translate(_QUOTES)
    return re.sub(r"[ \t]{2,}|\t", " ", text)


def folded(text: Column) -> Column:
    """``fold`` of a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold(t))

    return run(text)


def with_folded(segs: DataFrame) -> DataFrame:
    """``segs`` with folded, its text's ``fold``; texts are taken a slice of a batch at a time."""
    names = [*segs.columns, "folded"]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else fold(t) for t in b.column("text").to_pylist()], pa.string())], names=names)

    return segs.mapInArrow(run, ", ".join([*fields(segs), "folded string"]))


#: Rules on the raw text: rule, severity, kinds, Java pattern.
RAW_RULES = [
    ("hidden-unicode-tags", "high", ("prose", "code", "comment", "front"), TAGS),
    ("bidi-control", "high", ("prose", "code", "comment", "front"), BIDI),
    ("zero-width", "medium", ("prose", "code", "comment", "front"), ZERO_WIDTH),
    ("control-characters", "medium", ("prose", "code", "comment", "front"), CONTROL),
    ("variation-selectors", "medium", ("prose", "code", "comment"), r"[\x{E0100}-\x{E01EF}]|[\x{FE00}-\x{FE0F}]{2,}"),
    ("padding", "medium", ("prose", "code", "comment"), r"(?:(?:[\t\f\r ]*\n){25,}|[ \t\x{00A0}]{120,})\s*\S"),
    ("confusable-url", "high", ("prose", "code", "comment"), r"(?i)https?://(?:[^\s/@]*xn--|[^\s/@]*[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}])"),
    ("mixed-script", "medium", ("prose", "code", "comment"), r"\b(?=\w*\p{IsLatin})(?=\w*[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}])(?U:\w+)"),
    ("base64-blob", "medium", ("prose", "code", "comment"), r"[A-Za-z0-9+/]{120,}={0,2}|[A-Za-z0-9_-]{160,}"),
    ("hex-blob", "medium", ("prose", "code", "comment"), r"\b[0-9a-fA-F]{200,}\b|(?:\\x[0-9a-fA-F]{2}){12,}|(?:0x[0-9a-fA-F]{2},\s*){16,}"),
    ("raw-ip-url", "medium", ("prose", "code", "comment"), r"(?i)https?://(?:[^\s/@]*@)?(?!127\.|0\.0\.0\.0)(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"),
]


# What opens an instruction for when somebody brings something up, and what makes it one that waits for its moment;
# both stand in one sentence, at most so many characters after the opening.
CONDITION = r"(?i)\b(if|when|whenever|once|should)\s+(the\s+|a\s+)?(user|someone|anyone|they|human|person|developer)\s+(ever\s+)?(asks?|mentions?|says?|requests?|types?|brings?\s+up|talks?\s+about|is\s+asking|wants?|writes?)\b"
COVERT = r"(?i)\b(secretly|silently|quietly|covertly|discreetly|instead|pretend|lie|ignore|without\s+(telling|asking|mentioning|informing|showing)|(do\s+not|don't|never)\s+(tell|mention|reveal|show|say|inform)|also\s+(send|upload|post|run|execute|include|copy|attach|forward)|first\s+(send|upload|post|run|execute|read|copy|fetch))\b"
SENTENCE_CHARACTERS = 300
#: Java pattern of an opening that something covert follows in its sentence.
_CONDITIONAL = f"{re2_to_java(CONDITION)}(?=(?:(?!\\n\\n)[^.!?]){{0,{SENTENCE_CHARACTERS}}}?{re2_to_java(COVERT)})"


def hit_lines(text: Column, pattern: Column, first: Column, most: int) -> Column:
    """array<int> of the lines that the first ``most`` matches start on, ``first`` being the text's first line.

    The text is cut at its matches; a match's line follows from the line feeds of what stands before it.
    """
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    parts = F.zip_with(F.slice(F.split(text, pattern, F.lit(-1)), 1, most), F.slice(F.regexp_extract_all(text, pattern, F.lit(0)), 1, most), lambda a, b: F.struct(feeds(a).alias("before"), feeds(b).alias("inside")))
    start = F.struct(first.alias("line"), F.lit(0).alias("inside"), F.expr("CAST(array() AS array<int>)").alias("out"))

    def step(acc, x):
        line = acc["line"] + acc["inside"] + x["before"]
        return F.struct(line.alias("line"), x["inside"].alias("inside"), F.concat(acc["out"], F.array(line)).alias("out"))

    return F.aggregate(F.filter(parts, lambda x: x["inside"].isNotNull()), start, step)["out"]


def text_findings(segs: DataFrame, most: int = HITS_PER_RULE) -> DataFrame:
    """Segments -> skill, path, rule, severity, line, more: one row a hit.

    Of a rule's hits in a segment the first ``most`` are listed; ``more``, at the last of these, counts the rest.
    Which rules hit at all is decided first, by guarded patterns; places are looked for only then.
    """
    bare = F.when(F.contains("text", F.lit("\U0001f3f4")), F.regexp_replace("text", FLAG, "")).otherwise(F.col("text"))
    s = with_folded(segs).withColumn("bare", bare)
    s = s.withColumn("low", lowered(F.col("folded"))).withColumn("raw_low", lowered(F.col("bare")))
    kinds_of = lambda kinds: F.col("kind").isin(*kinds)
    found = lambda rule, severity, pattern, raw: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(pattern).cast("string").alias("pattern"), F.lit(raw).alias("raw"))
    out = [F.when(kinds_of(kinds) & _raw_guard(p) & F.col("bare").rlike(p), found(rule, severity, p, True)) for rule, severity, kinds, p in RAW_RULES]
    out += [F.when(kinds_of(kinds) & matches(F.col("folded"), F.col("low"), p), found(rule, severity, re2_to_java(p), False)) for rule, severity, kinds, p in TEXT_RULES]
    both = matches(F.col("folded"), F.col("low"), CONDITION) & matches(F.col("folded"), F.col("low"), COVERT)
    out.append(F.when((F.col("kind") == "prose") & both, found("conditional-trigger", "high", _CONDITIONAL, False)))
    out.append(F.when((F.col("kind") == "comment") & (F.size(F.split(F.trim("text"), r"\s+")) >= 3), found("html-comment", "medium", None, True)))
    out.append(F.when(F.col("load_time"), found("load-time-shell", "medium", None, True)))
    hits = s.select("skill", "path", F.col("line").alias("first"), "folded", "bare", F.inline(F.filter(F.array(*out), lambda x: x.isNotNull())))
    text = F.when(F.col("raw"), F.col("bare")).otherwise(F.col("folded"))
    hits = hits.withColumn("text", text).drop("folded", "bare", "raw")
    n = F.when(F.col("pattern").isNull(), 1).otherwise(F.regexp_count("text", F.col("pattern")))
    lines = F.when(F.col("pattern").isNull(), F.array("first")).otherwise(hit_lines(F.col("text"), F.col("pattern"), F.col("first"), most))
    each = hits.select("skill", "path", "rule", "severity", n.alias("n"), F.posexplode(lines).alias("pos", "line"))
    more = F.when(F.col("pos") == most - 1, F.col("n") - most).otherwise(0)
    return each.select("skill", "path", "rule", "severity", F.col("line").cast("int").alias("line"), more.cast("int").alias("more")).distinct()


def _raw_guard(pattern: str) -> Column:
    """What a pattern of ``RAW_RULES`` needs, where that is cheap to see."""
    if pattern.startswith("(?i)http"):
        return F.col("raw_low").contains("http")
    return may_match(F.col("raw_low"), pattern) if pattern.startswith("(?i)") else F.lit(True)


def file_findings(files: DataFrame) -> DataFrame:
    """``files``: skill, path, kind (file, symlink, special, repository), content binary, size -> skill-level findings."""
    magic = F.hex(F.substring("content", 1, 4))
    executable = magic.startswith("7F454C46") | magic.startswith("4D5A") | magic.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "0061736D") | F.lower("path").rlike(r"\.(pyc|so|dylib|dll|exe|jar|class)$")
    archive = magic.startswith("504B0304") | magic.startswith("1F8B") | F.lower("path").rlike(r"\.(zip|tar|gz|tgz|7z|rar|xz)$")
    image = F.lower("path").rlike(r"\.(png|jpe?g|gif|webp|svg|ico|bmp)$")
    broken = F.col("content").isNotNull() & ~F.is_valid_utf8(F.col("content").cast("string"))
    tests = [
        ("symlink", "high", F.col("kind") == "symlink"), ("special-file", "high", F.col("kind") == "special"), ("git-repository", "medium", F.col("kind") == "repository"),
        ("executable-file", "high", executable), ("opaque-file", "medium", archive & ~executable), ("oversized-file", "medium", F.col("size") > SCAN_BYTES),
        ("malformed-text", "high", broken & F.lower("path").rlike(r"\.(md|txt|ya?ml|json|py|sh|js)$") & ~executable & ~image),
    ]
    hits = F.array(*[F.when(t, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, t in tests])
    return files.select("skill", "path", F.inline(F.filter(hits, lambda x: x.isNotNull()))).withColumn("line", F.lit(0))


# A name as skills have it, the longest name and description, and descriptions that claim every conversation.
SPEC_NAME, MOST_NAME, MOST_DESCRIPTION = r"[a-z0-9]+(-[a-z0-9]+)*", 64, 1024
BROAD = r"(?i)\b(always|every|all|any)\s+(time|task|request|question|prompt|message|conversation|turn|session|code|file|project|situation|case|change)s?\b|\b(use|invoke|load|apply|activate|run)\s+(this\s+skill\s+)?(for\s+|on\s+)?(everything|anything|always|first)\b|\bwhenever\s+possible\b|\bregardless\s+of\b|\bbefore\s+(any|every|all)\b|\bin\s+all\s+cases\b|\b(must|should)\s+always\s+be\s+(used|loaded|invoked|active)\b"
# What is said of front matter.
FRONT_DETAILS = {
    "no name": "the front matter has no name",
    "name": "the name is not 1-64 lowercase letters, digits and single hyphens",
    "no description": "the front matter has no description",
    "broad": "the {field} asks for the skill to be used far beyond what it does",
    "hooks": "the front matter registers hooks",
}
FRONT = "name string, description string, when_to_use string, allowed_tools string, hooks boolean, paths boolean, on_its_own boolean, error string"


def front_matter(segs: DataFrame) -> DataFrame:
    """skill and the columns of ``FRONT`` of each skill's SKILL.md; ``error`` says why there is no front matter to read.

    The text is YAML; members that are no texts where texts belong count as absent.
    """

    @F.pandas_udf(FRONT)
    def read(texts: pd.Series) -> pd.DataFrame:
        import yaml

        def one(text):
            if text is None:
                return (None,) * 4 + (False, False, True, "there is no front matter")
            try:
                m = yaml.safe_load(text)
            except (yaml.YAMLError, ValueError):
                return (None,) * 4 + (False, False, True, "the front matter is no YAML")
            if not isinstance(m, dict):
                return (None,) * 4 + (False, False, True, "the front matter is no mapping")
            said = [m.get(k) if isinstance(m.get(k), str) else None for k in ("name", "description", "when_to_use")]
            tools = m.get("allowed-tools")
            tools = ", ".join(map(str, tools)) if isinstance(tools, list) else tools if isinstance(tools, str) else None
            return (*said, tools, m.get("hooks") is not None, m.get("paths") is not None, m.get("disable-model-invocation") is not True, None)

        return pd.DataFrame([one(t) for t in texts], columns=[f.split()[0] for f in FRONT.split(", ")])

    manifest = segs.where("path = 'SKILL.md'")
    text = manifest.groupBy("skill").agg(F.min(F.when(F.col("kind") == "front", F.struct("line", "text"))).alias("f"))
    return text.select("skill", read(F.col("f.text")).alias("m")).select("skill", "m.*")


def front_findings(segs: DataFrame) -> DataFrame:
    """skill, path, rule, severity, line, detail of what is wrong with a skill's front matter or what it asks for."""
    f = front_matter(segs)
    none = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""
    name = F.col("name")
    wrong_name = F.when(none("name"), FRONT_DETAILS["no name"]).when((F.length(name) > MOST_NAME) | ~name.rlike(rf"\A{SPEC_NAME}\z"), FRONT_DETAILS["name"]).when(name != F.element_at(F.split("skill", "/"), -1), "the name is not the directory's")
    broad = lambda c: F.col("on_its_own") & ~F.col("paths") & folded(F.coalesce(c, F.lit(""))).rlike(re2_to_java(BROAD))
    tests = [
        ("invalid-frontmatter", "low", F.coalesce("error", wrong_name)), ("invalid-frontmatter", "low", F.when(F.col("error").isNull() & none("description"), FRONT_DETAILS["no description"])),
        ("description-too-long", "low", F.when(F.length("description") > MOST_DESCRIPTION, F.format_string("the description is %d characters long", F.length("description")))),
        ("broad-trigger", "medium", F.when(broad("description"), FRONT_DETAILS["broad"].format(field="description"))),
        ("broad-trigger", "medium", F.when(broad("when_to_use"), FRONT_DETAILS["broad"].format(field="when_to_use"))),
        ("skill-hooks", "medium", F.when(F.col("hooks"), FRONT_DETAILS["hooks"])),
    ]
    hits = F.array(*[F.when(d.isNotNull(), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), d.alias("detail"))) for r, s, d in tests])
    return f.select("skill", F.lit("SKILL.md").alias("path"), F.inline(F.filter(hits, lambda x: x.isNotNull()))).select("skill", "path", "rule", "severity", F.lit(1).alias("line"), "detail")


def labels(segs: DataFrame) -> DataFrame:
    """skill -> its capabilities in fixed order, and the hosts its URLs name."""
    order = ["shell", "scripts", "network", "urls", "secrets", "file-write", "package-install", "external-include", "auto-trigger", "preapproved-tools"]
    segs = segs.withColumn("low", lowered(F.col("text")))
    hits = [F.when(F.col("kind").isin(*kinds) & matches(F.col("text"), F.col("low"), p), cap) for cap, kinds, p in CAPABILITIES]
    hits.append(F.when((F.col("kind") == "code") & F.col("lang").isin("sh", "bash", "zsh", "shell", "console", "powershell"), "shell"))
    hits.append(F.when(F.lower("path").rlike(r"\.(py|sh|bash|js|ts|rb|pl|ps1|go|php|lua)$"), "scripts"))
    hosts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\bhttps?://(?:[^\s/@\"'<>]*@)?([A-Za-z0-9.-]+)"), 1), lambda h: F.lower(h)), lambda h: ~h.rlike(r"^(localhost|127\.|0\.0\.0\.0)"))
    hits.append(F.when(F.size(hosts) > 0, "urls"))
    hits.append(F.when((F.col("kind") == "front") & F.col("text").rlike(r"(?m)^hooks\s*:"), "auto-trigger"))
    hits.append(F.when((F.col("kind") == "front") & F.col("text").rlike(r"(?m)^allowed-tools\s*:"), "preapproved-tools"))
    each = segs.select("skill", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("caps"), hosts.alias("hosts"))
    got = each.groupBy("skill").agg(F.array_distinct(F.flatten(F.collect_set("caps"))).alias("caps"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hosts")))).alias("hosts"))
    return got.select("skill", F.filter(F.array(*map(F.lit, order)), lambda c: F.array_contains("caps", c)).alias("labels"), "hosts")


def label_evidence(segs: DataFrame, most: int = HITS_PER_RULE) -> DataFrame:
    """skill, capability, path, line: where a skill's texts show a capability, the first ``most`` places of a segment."""
    s = segs.withColumn("low", lowered(F.col("text")))
    shown = F.array(*[F.when(F.col("kind").isin(*kinds) & matches(F.col("text"), F.col("low"), p), F.struct(F.lit(cap).alias("capability"), F.lit(re2_to_java(p)).alias("pattern"))) for cap, kinds, p in CAPABILITIES])
    hits = s.select("skill", "path", F.col("line").alias("first"), "text", F.inline(F.filter(shown, lambda x: x.isNotNull())))
    return hits.select("skill", "capability", "path", F.explode(hit_lines(F.col("text"), F.col("pattern"), F.col("first"), most)).alias("line")).distinct()


def check(skills: DataFrame, locked: DataFrame) -> DataFrame:
    """Both: skill, root, labels, hosts -> skill, status (locked, new, changed, removed), gained and lost capabilities, new hosts."""
    j = skills.alias("s").join(locked.alias("l"), "skill", "full_outer")
    status = F.when(F.col("l.root").isNull(), "new").when(F.col("s.root").isNull(), "removed").when(F.col("s.root") == F.col("l.root"), "locked").otherwise("changed")
    minus = lambda a, b: F.coalesce(F.array_except(a, b), F.array().cast("array<string>"))
    return j.select("skill", status.alias("status"), minus("s.labels", "l.labels").alias("gained"), minus("l.labels", "s.labels").alias("lost"), minus("s.hosts", "l.hosts").alias("new_hosts"))


def read_skills(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root``/<skill>/ -> skill, path (below its skill), kind, content, size, hash.

    Any store that Spark reads; links and folders are not seen there, so every kind is file. The hash of a text has its
    line ends as line feeds, so a checkout on another system changes nothing.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.url_decode(F.replace(F.regexp_replace(F.expr("_metadata.file_path"), r"^\w+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    f = f.withColumn("below", F.substr(below, F.lit(len(base) + 2))).where("contains(below, '/')")
    skill = F.substring_index("below", "/", 1)
    text = F.is_valid_utf8(F.col("content").cast("string")) & (F.locate("\0", F.col("content").cast("string")) == 0)
    unix = F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n")).cast("binary")
    hash_ = F.sha2(F.when(text, unix).otherwise(F.col("content")), 256)
    return f.select(skill.alias("skill"), F.substr("below", F.length(skill) + 2).alias("path"), F.lit("file").alias("kind"), "content", F.col("length").alias("size"), hash_.alias("hash"))


def check_files(files: DataFrame, locked: DataFrame) -> DataFrame:
    """Both: skill, path, hash -> skill, path, status (added, removed or changed) of the files that differ."""
    f, k = (t.select("skill", "path", F.col("hash").alias(name)) for t, name in ((files, "now"), (locked, "then")))
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return f.join(k, ["skill", "path"], "full_outer").select("skill", "path", status.alias("status")).where("status IS NOT NULL")


def severity_counts(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy(rank.desc())


def sarif(findings: DataFrame, tool: str = "tracewell") -> Column:
    """A finding as a SARIF 2.1.0 result, one JSON text a row."""
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"))).alias("result"))
