"""Every pattern once in each dialect. Python's \\w, \\d, \\s and \\b are Unicode; Java needs them spelled out."""

from __future__ import annotations

# Java looks behind by whole code points only in patterns that spell one out beyond the BMP; both are in their classes already
W = "[\\p{L}\\p{N}_\U00010400]"
NOT_AFTER_DIGIT = "(?<![\\p{Nd}\U000104a0])"
NOT_AFTER, NOT_BEFORE = rf"(?<!{W})", rf"(?!{W})"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
ND, SP = r"\p{Nd}", r"[\s\x{1c}-\x{1f}]"

# Python patterns of the detectors, in detector order
_SEP = r"[ \t.-]"
PYTHON = {
    "AWS_ACCOUNT_ID": r"arn:aws[a-zA-Z0-9-]*:[a-zA-Z0-9-]*:[a-zA-Z0-9-]*:(?P<arn_id>\d{12}):|(?<!\d)(?P<bare_id>\d{4}-\d{4}-\d{4}|\d{12})(?!\d)",
    "AWS_ACCESS_KEY_ID": r"(?<![A-Z0-9])(?:ABIA|ACCA|AGPA|AIDA|AIPA|AKIA|ANPA|ANVA|APKA|AROA|ASCA|ASIA)[A-Z0-9]{16,}(?![A-Z0-9])",
    "PHONE_NUMBER": rf"(?<!\w)(?:\+\d{{7,14}}|(?:\+\d{{1,3}}{_SEP}?)?(?:\(\d{{2,4}}\){_SEP}?)?\d{{2,4}}(?:{_SEP}\d{{2,4}}){{1,3}})(?!\w)",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "USERNAME_MENTION": r"(?<!\w)@[A-Za-z0-9][A-Za-z0-9-]{2,36}[A-Za-z0-9]\b",
    "URL": r"(?i)\b(?:https?|ftp)://[^\s<>\"')\]]+",
    "URL_WWW": r"(?i)\bwww\.[^\s<>\"')\]]+",
    "SLACK_TOKEN": r"\bxox[baprs]-[A-Za-z0-9-]{10,72}\b|\bxapp-[A-Za-z0-9-]{10,72}\b",
    "SLACK_WEBHOOK": r"(?:https?://)?hooks\.slack\.com/services/[A-Za-z0-9]+/[A-Za-z0-9]+/[A-Za-z0-9]+",
    "ATLASSIAN_API_TOKEN": r"\bATATT3[A-Za-z0-9_=-]{100,}\b",
    "GITHUB_TOKEN": r"\bgh[oprsu]_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{80,}\b",
    "ANTHROPIC_API_KEY": r"\bsk-ant-[A-Za-z0-9_-]{20,}\b",
    "OPENAI_API_KEY": r"\bsk-(?!ant-)(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}\b",
    "NOTION_TOKEN": r"\bsecret_[A-Za-z0-9]{43}\b|\bntn_[A-Za-z0-9]{35,}\b",
    "JWT": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
}
# The shapes of dates and times
DATES = {
    "ymd": r"(?<!\d)(?P<year>\d{4})(?P<sep>[-/.])(?P<month>\d{1,2})(?P=sep)(?P<day>\d{1,2})(?:[T ](?P<hour>\d{2}):(?P<minute>\d{2})(?::(?P<second>\d{2}))?Z?)?(?!\d)",
    "dmy": r"(?<!\d)(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<year>\d{4})(?!\d)",
    "compact": r"(?<!\d)(?P<year>\d{4})(?P<month>\d{2})(?P<day>\d{2})(?:T(?P<hour>\d{2})(?P<minute>\d{2})(?P<second>\d{2})?Z?)?(?!\d)",
    "time": r"(?<!\d)(?P<hour>\d{1,2})\.(?P<minute>\d{2})\.(?P<second>\d{2})(?!\d)",
}
#: What each match starts with, as a Java lookahead: tried before any look behind, it lets most positions go at once
#: (an address's is where a run of its characters begins or the match before ended)
HEADS = {
    "AWS_ACCOUNT_ID": r"(?=[a\p{Nd}])",
    "AWS_ACCESS_KEY_ID": "(?=A)",
    "PHONE_NUMBER": r"(?=[+(\p{Nd}])",
    "EMAIL": r"(?:(?<![A-Za-z0-9._%+-])|\G)",  # where a run's first character starts no match, none of it does: else long runs cost their square
    "USERNAME_MENTION": "(?=@)",
    "URL": "(?=[hf])",
    "URL_WWW": "(?=w)",
    "SLACK_TOKEN": "(?=x)",
    "SLACK_WEBHOOK": "(?=h)",
    "ATLASSIAN_API_TOKEN": "(?=A)",
    "GITHUB_TOKEN": "(?=g)",
    "ANTHROPIC_API_KEY": "(?=s)",
    "OPENAI_API_KEY": "(?=s)",
    "NOTION_TOKEN": "(?=[sn])",
    "JWT": "(?=e)",
}
#: Of these strings, every text with a match holds one
GATES = {
    "AWS_ACCESS_KEY_ID": ("ABIA", "ACCA", "AGPA", "AIDA", "AIPA", "AKIA", "ANPA", "ANVA", "APKA", "AROA", "ASCA", "ASIA"),
    "EMAIL": ("@",),
    "USERNAME_MENTION": ("@",),
    "URL": ("://",),
    "SLACK_TOKEN": ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-", "xapp-"),
    "SLACK_WEBHOOK": ("hooks.slack.com/services/",),
    "ATLASSIAN_API_TOKEN": ("ATATT3",),
    "GITHUB_TOKEN": ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_"),
    "ANTHROPIC_API_KEY": ("sk-ant-",),
    "OPENAI_API_KEY": ("sk-",),
    "NOTION_TOKEN": ("secret_", "ntn_"),
    "JWT": ("eyJ",),
}
SSH = r"git@([A-Za-z0-9.-]+):([A-Za-z0-9][A-Za-z0-9-]{0,38})/"
LABEL = r"(?i)\b(?:User|Username)\s*:\s*([A-Za-z0-9._@-]+)"
# First path segments that are the platform's own pages, its hosts, and how long a name is at least
RESERVED = (
    "about", "account", "admin", "announcements", "api", "apps", "blog", "business", "codespaces", "collections", "contact", "copilot",
    "customer-stories", "dashboard", "discussions", "education", "enterprise", "events", "explore", "features", "gist", "gists", "help", "home",
    "issues", "join", "login", "logout", "marketplace", "new", "nonprofit", "notifications", "organizations", "orgs", "plans", "pricing", "privacy",
    "pulls", "readme", "security", "settings", "site", "sponsors", "star", "stars", "support", "team", "terms", "topics", "trending", "watching",
    "search",
)
HOSTS = ("github.com", "www.github.com")
MIN_NAME, MIN_LABELLED = 3, 5
NAME = r"^[A-Za-z0-9](?:-?[A-Za-z0-9])*$"
OWNER, HOST = r"^[A-Za-z]+://[^/?#]*/+([^/?#]*)", r"^[A-Za-z]+://([^/?#]*)"
SENSITIVE_KEY = r"(?i)account.?(id|number)|ssn|social.?security|passport|api.?key|secret|password|token|credential"
TASK_ITEM = r"(?m)^([ \t]*)([-*+])\s\[([ xX])\]\s+(.*)$"


def java(pattern: str) -> str:
    """The Java form of one of the patterns above."""
    out, i, in_class = [], 0, False
    if pattern.startswith("(?i)"):
        out.append("(?iU)")
        i = 4
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern.startswith(r"(?<!\d)", i):
            out.append(NOT_AFTER_DIGIT)
            i += len(r"(?<!\d)")
            continue
        if two == r"\d":
            out.append(ND)
        elif two == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else W)
        elif two == r"\s":
            out.append(r"\s\x{1c}-\x{1f}" if in_class else SP)
        elif two == r"\b":
            out.append(EDGE)
        elif two[0:1] == "\\":
            out.append(two)
        elif pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.index(">", i)]
            out.append(f"(?<{name.replace('_', '')}>")
            i += len(name) + 5
            continue
        elif pattern.startswith("(?P=", i):
            name = pattern[i + 4 : pattern.index(")", i)]
            out.append(rf"\k<{name}>")
            i += len(name) + 5
            continue
        else:
            c = pattern[i]
            in_class = True if c == "[" else False if c == "]" and in_class else in_class
            out.append(c)
            i += 1
            continue
        i += 2
    return "".join(out)


def searched(kind: str) -> str:
    """The Java form of an entity type's pattern, for searching: behind its lookahead."""
    pattern = java(PYTHON[kind])
    flags, body = (pattern[:5], pattern[5:]) if pattern.startswith("(?iU)") else ("", pattern)
    return f"{flags}{HEADS[kind]}(?:{body})" if kind in HEADS else pattern
