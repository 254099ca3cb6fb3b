"""Policies as data: loading, validation, packs.

A policy is a mapping (from YAML or JSON): default, mode, budget, loop_guard,
labels, packs, rules.  All errors are reported at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.regexes import PatternError, check_pattern, name_matches
from .packs import PACKS

ACTIONS = ("allow", "ask", "deny")
MATCHERS = ("equals", "not_equals", "regex", "not_regex", "shell_regex", "not_shell_regex", "sql_regex", "not_sql_regex", "prefix", "not_prefix", "path_prefix", "not_path_prefix", "in", "gt", "lt", "exists", "includes", "excludes")
#: Labels the engine itself gives a session.
OWN_LABELS = ("canary-read", "injection-suspected", "behavior-anomaly")


# Reasons of decisions that come from no rule of one's own.
REASONS = {
    "frozen": "calls are frozen until they are let through again",
    "loop-guard": "loop guard: the identical call has been made {n} times in a row; change the arguments or stop",
    "calls_per_session": "budget: session limit of {n} calls reached",
    "calls_per_minute": "budget: rate limit of {n} calls per minute reached, slow down",
    "tokens_per_session": "budget: session limit of roughly {n} tokens through tools reached",
    "calls_per_tool": "budget: limit of {n} calls for {tool} reached",
    "spent": "budget: the {what} budget of {limit} is spent",
    "too dear": "budget: this call costs {price} and only {left} of the {what} budget is left",
    "rule": "matched rule {rule}",
    "rule of a tool": "matched rule {rule} ({tool})",
    "default": "default {action}",
}


class PolicyError(ValueError):
    """All that is wrong with a policy, one line each."""


@dataclass
class Condition:
    path: str
    matcher: dict


@dataclass
class Rule:
    id: str
    action: str
    tool: str = ""
    when: list[Condition] = field(default_factory=list)
    reason: str = ""
    quorum: int = 0

    def text(self) -> str:
        return self.reason or REASONS["rule of a tool" if self.tool else "rule"].format(rule=self.id, tool=self.tool)


@dataclass
class LabelRule:
    label: str
    tool: str = ""
    when: list[Condition] = field(default_factory=list)


@dataclass
class Policy:
    default: str = "allow"
    mode: str = "enforce"
    rules: list[Rule] = field(default_factory=list)
    labels: list[LabelRule] = field(default_factory=list)
    calls_per_session: int = 0
    calls_per_minute: int = 0
    tokens_per_session: int = 0
    calls_per_tool: dict[str, int] = field(default_factory=dict)
    repeats: int = 0
    money: dict = field(default_factory=dict)
    packs: list[str] = field(default_factory=list)


def conditions(when, errors: list[str], where: str) -> list[Condition]:
    """A mapping of path to matcher, or a list of such mappings; a bare value means equals, a list means in."""
    out = []
    for part in [when] if isinstance(when, dict) else when or []:
        if not isinstance(part, dict):
            errors.append(f"{where}: when is a mapping of path to matcher, or a list of them")
            continue
        for path, m in part.items():
            m = m if isinstance(m, dict) else {"in": m} if isinstance(m, list) else {"equals": m}
            unknown = [k for k in m if k not in MATCHERS]
            if unknown:
                errors.append(f"{where}: {path}: unknown matcher {unknown[0]}")
            elif not m or (len(m) > 1 and set(m) != {"gt", "lt"}):
                errors.append(f"{where}: {path}: exactly one matcher is expected (gt and lt may be combined)")
            else:
                out.append(Condition(path, m))
    return out


def _filled(value, params: dict):
    """A matcher's values with the pack's parameters; a whole-value placeholder takes the parameter's own type."""
    if isinstance(value, dict):
        return {k: _filled(v, params) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, params) for v in value]
    if not isinstance(value, str):
        return value
    whole = re.fullmatch(r"\{\{(\w+)\}\}", value)
    if whole:
        v = params[whole[1]]
        return float(v) if re.fullmatch(r"-?\d+(\.\d+)?", str(v)) else v
    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(params[m[1]]), value)


def expand_pack(entry, errors: list[str]) -> tuple[list[Rule], list[LabelRule]]:
    """A pack's rules (ids prefixed by its name) and labels."""
    name, given = (entry, {}) if isinstance(entry, str) else (entry.get("name"), entry.get("with") or {})
    pack = PACKS.get(name)
    if pack is None:
        errors.append(f"pack {name}: not known")
        return [], []
    params = {}
    for key, spec in (pack.get("params") or {}).items():
        value = given.get(key, spec.get("default"))
        if value is None:
            errors.append(f"pack {name}: parameter {key} is required")
            value = ""
        params[key] = clean_path(str(value)) if spec.get("path") and value else value
    errors += [f"pack {name}: unknown parameter {k}" for k in given if k not in (pack.get("params") or {})]
    when = lambda conds: [Condition(p, _filled(m, params)) for p, m in conds]
    rules = [Rule(f"{name}/{i}", action, tool, when(conds), _filled(reason, params)) for i, tool, conds, action, reason in pack["rules"]]
    return rules, [LabelRule(label, tool, when(conds)) for label, tool, conds in pack.get("labels", [])]


def clean_path(path: str) -> str:
    """The shortest lexical form of a path."""
    out: list[str] = []
    rooted = path.startswith("/")
    for part in path.replace("\\", "/").split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", ".") and not (part == ".." and rooted):
            out.append(part)
    return ("/" if rooted else "") + "/".join(out) or "."


KNOWN = {"default", "mode", "budget", "loop_guard", "labels", "packs", "rules", "version", "redact_results", "result_scan"}


def load(spec: dict) -> Policy:
    """A policy from a mapping; raises PolicyError with every mistake."""
    errors = [f"unknown key {k}" for k in spec if k not in KNOWN]
    b = spec.get("budget") or {}
    p = Policy(default=spec.get("default") or "allow", mode=spec.get("mode") or "enforce", repeats=(spec.get("loop_guard") or {}).get("repeats", 0))
    for k in ("calls_per_session", "calls_per_minute", "tokens_per_session", "calls_per_tool", "money"):
        if k in b:
            setattr(p, k, b[k])
    if any(isinstance(v, (int, float)) and v < 0 for v in (p.calls_per_session, p.calls_per_minute, p.tokens_per_session, p.repeats, *p.calls_per_tool.values())):
        errors.append("budget: limits are not negative")
    if p.default not in ("allow", "deny"):
        errors.append(f"default: {p.default} is neither allow nor deny")
    if p.mode not in ("enforce", "shadow"):
        errors.append(f"mode: {p.mode} is neither enforce nor shadow")
    for i, r in enumerate(spec.get("rules") or []):
        where = f"rule {r.get('id') or i}"
        rule = Rule(r.get("id", ""), r.get("action", ""), r.get("tool", ""), conditions(r.get("when"), errors, where), r.get("reason", ""), r.get("quorum", 0))
        if not rule.id:
            errors.append(f"{where}: it has no id")
        if rule.action not in ACTIONS:
            errors.append(f"{where}: action {rule.action!r}")
        if not 0 <= rule.quorum <= 9 or (rule.quorum and rule.action != "ask"):
            errors.append(f"{where}: quorum is 0 to 9, on ask rules")
        errors += [f"{where}: {c.path}: only label rules see results" for c in rule.when if c.path.startswith("result.")]
        p.rules.append(rule)
    for r in spec.get("labels") or []:
        label = r.get("label", "")
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", label):
            errors.append(f"label {label!r}: lower-case letters, digits, dashes and underscores")
        p.labels.append(LabelRule(label, r.get("tool", ""), conditions(r.get("when"), errors, f"label {label}")))
    for entry in spec.get("packs") or []:
        rules, labels = expand_pack(entry, errors)
        p.rules += rules
        p.labels += labels
        p.packs.append(entry if isinstance(entry, str) else entry.get("name"))
    seen = set()
    for r in p.rules:
        if r.id in seen:
            errors.append(f"rule {r.id}: the id is used twice")
        seen.add(r.id)
    for w in [*p.rules, *p.labels]:
        for c in w.when:
            for k in c.matcher:
                if "regex" in k:
                    try:
                        check_pattern(str(c.matcher[k]))
                    except PatternError as e:
                        errors.append(f"{c.path}: {k}: {e}")
        if len(w.tool) > 1 and w.tool.startswith("/") and w.tool.endswith("/"):
            try:
                check_pattern(w.tool[1:-1])
            except PatternError as e:
                errors.append(f"tool {w.tool}: {e}")
    if errors:
        raise PolicyError("\n".join(errors))
    return p


def load_yaml(text: str) -> Policy:
    """A policy from YAML (the ``policy:`` part of a configuration, or the policy itself)."""
    import yaml

    spec = yaml.safe_load(text) or {}
    return load(spec.get("policy", spec))


def lint(p: Policy, tools: list[str] | None = None, approvals: str = "") -> list[tuple[str, str, str]]:
    """(severity, check, rule) of what is legal but likely a mistake; warnings first. ``approvals``: how asks are answered (deny: never)."""
    out = []
    covers_all = lambda r: r.tool in ("", "*") and not r.when
    labels = {x.label for x in p.labels} | set(OWN_LABELS)
    blocked = None
    for r in p.rules:
        if blocked:
            out.append(("warn", "unreachable", r.id))
        blocked = blocked or covers_all(r)
        if covers_all(r) and p.packs and not any(r.id.startswith(f"{name}/") for name in p.packs):
            out.append(("warn", "packs-unreachable", r.id))
        if tools is not None and r.tool and not any(name_matches(r.tool, t) or name_matches(r.tool, t.replace("__", ".", 1)) for t in tools):
            out.append(("warn", "unknown-tool", r.id))
        for c in r.when:
            kind = next(iter(c.matcher))
            value = c.matcher[kind]
            if r.action == "allow" and "[*]" in c.path:
                out.append(("warn", "allow-any-value", r.id))
            if r.action == "allow" and kind == "regex" and not str(value).lstrip("(?ims)").startswith(("^", r"\A")):
                out.append(("warn", "unanchored-allow", r.id))
            if kind in ("prefix", "not_prefix") and str(value).startswith("/") and not str(value).endswith("/"):
                out.append(("info", "prefix-without-slash", r.id))
            if r.action == "allow" and c.path.startswith("annotations."):
                out.append(("info", "trusts-annotations", r.id))
            if c.path.startswith("session.label.") and c.path[14:] not in labels:
                out.append(("warn", "unknown-label", r.id))
            if kind == "not_equals" and c.path in ("session.labels", "session.called"):
                out.append(("warn", "not-equals-on-a-list", r.id))
    if p.default == "allow" and not any(r.action != "allow" for r in p.rules) and not (p.calls_per_session or p.calls_per_minute or p.tokens_per_session or p.calls_per_tool or p.money):
        out.append(("info", "nothing-blocks", ""))
    if approvals == "deny" and any(r.action == "ask" for r in p.rules):
        out.append(("warn", "ask-without-approvals", ""))
    if p.mode == "shadow":
        out.append(("info", "shadow", ""))
    return sorted(out, key=lambda x: x[0] != "warn")



def summary(p: Policy) -> str:
    """What a policy is made of, in a line."""
    n = {a: sum(r.action == a for r in p.rules) for a in ACTIONS}
    said = [f"default {p.default}", f"{len(p.rules)} rules ({n['allow']} allow, {n['deny']} deny, {n['ask']} ask)"]
    said += [f"{len(p.labels)} labels"] if p.labels else []
    said += [f"packs {', '.join(p.packs)}"] if p.packs else []
    return ", ".join(said + (["shadow mode"] if p.mode == "shadow" else []))
