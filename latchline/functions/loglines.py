"""Reading the header of one log line with a weighted grammar of layouts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

from latchline.functions.earley import Grammar, spans
from latchline.functions.timeparse import MONTHS, micros_of

# Level words and letters, and the six levels they mean.
LEVELS = {
    "trace": "TRACE", "verbose": "TRACE", "finest": "TRACE", "finer": "TRACE",
    "debug": "DEBUG", "fine": "DEBUG",
    "info": "INFO", "information": "INFO", "notice": "INFO", "config": "INFO",
    "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL", "panic": "FATAL",
}
LETTERS = {"T": "TRACE", "V": "TRACE", "D": "DEBUG", "I": "INFO", "N": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
MARKS = {"error": "ERROR", "warning": "WARN", "notice": "INFO", "debug": "DEBUG"}
# The field names under which structured layouts give time, level, function, logger and message.
KEYS = {
    "KTS": ("ts", "time", "timestamp", "@timestamp", "datetime", "date", "@t"),
    "KLV": ("level", "lvl", "severity", "loglevel", "log_level", "levelname"),
    "KFN": ("func", "function", "funcname", "func_name", "fn", "method"),
    "KLG": ("component", "logger", "logger_name", "name", "program", "module", "file", "caller"),
    "KMS": ("message", "msg", "text", "@m"),
}
KEY_CLASS = {k: c for c, names in KEYS.items() for k in names}

#: Tokens by what they begin with: a blank, a digit, a letter, anything else.
_TEXT = re.compile(
    r"(?P<SP> +)"
    r"|(?=\d)(?:(?P<YMD>\d{4}[-/]\d\d[-/]\d\d(?!\d))|(?P<DMY>\d\d\.\d\d\.\d{4}(?!\d))|(?P<HMS>\d\d:\d\d:\d\d(?!\d))|(?P<EPOCH>\d{10}(?=\.\d))|(?P<INT>\d+))"
    r"|(?=[^\W\d])(?:(?P<GLOG>[TVDIWEFC]\d{4}(?!\w))|(?P<TEE>T(?=\d\d:))|(?P<ZED>Z(?!\w))"
    r"|(?P<TL>L:)|(?P<TD>D:)|(?P<TFN>F[Nn]:)|(?P<TF>F:)|(?P<TC>C:)|(?P<TT>TI?:)|(?P<TR>R:)"
    r"|(?P<MON>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?![\w.]))|(?P<WDAY>(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?![\w.]))"
    r"|(?P<LETTER>[TVDINWEFC](?![\w.:-]))|(?P<NAME>[\w$]+(?:[.-][\w$]+)*))"
    r"|(?P<PRI><\d{1,3}>)|(?P<MARK>\#\#\[\w+\]|::(?:error|warning|notice|debug)(?: [^:]*)?::)"
    r"|(?P<FRAC>[.,]\d+)|(?P<ZONE>(?<=\d)[+-]\d\d:?\d\d(?!\d))|(?P<DASHES>-{3})|(?P<TAB>\t)|(?P<CHAR>.)",
    re.DOTALL,
)
_JSON = re.compile(r'(?P<WS>\s+)|(?P<STR>"(?:[^"\\]|\\.)*")|(?P<NUM>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<LIT>true|false|null)|(?P<CHAR>.)', re.DOTALL)
_PAIRS = re.compile(r'(?P<SP>\s+)|(?P<KEY>[@\w.-]+(?==))|(?P<EQ>=)|(?P<QUO>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(?P<BARE>[^\s"=]\S*)|(?P<CHAR>.)', re.DOTALL)

LAYOUTS = Grammar(
    """
    # A line opens an entry or continues one: indented, quoted, or with anything else
    Line -> Entry : 0.9
    Line -> Continuation : 0.1
    Continuation -> Indent : 0.4
    Continuation -> Quote : 0.3
    Continuation -> Other : 0.3
    Indent -> SP : 0.5
    Indent -> TAB : 0.5
    Quote -> > : 0.5
    Quote -> | : 0.5
    Other -> * : 1

    Entry -> Boot : 0.1
    Entry -> Bracketed : 0.1
    Entry -> Threaded : 0.1
    Entry -> Boxed : 0.1
    Entry -> Named : 0.1
    Entry -> Dashed : 0.1
    Entry -> Tagged : 0.1
    Entry -> Workflow : 0.1
    Entry -> Lettered : 0.1
    Entry -> Server : 0.1
    Entry -> Piped : 0.1
    Entry -> Syslog : 0.1
    Entry -> Counted : 0.1
    Entry -> Json : 0.1
    Entry -> Pairs : 0.1
    Entry -> Plain : 0.0001

    # Times
    Stamp -> YMD SP HMS FRAC : 0.4
    Stamp -> YMD SP HMS : 0.2
    Stamp -> Iso : 0.2
    Iso -> YMD TEE HMS FRAC ZED : 0.4
    Iso -> YMD TEE HMS ZED : 0.2
    Iso -> YMD TEE HMS FRAC ZONE : 0.2
    Iso -> YMD TEE HMS ZONE : 0.1
    Iso -> YMD TEE HMS FRAC : 0.1
    Iso -> YMD TEE HMS : 0.1
    European -> DMY SP HMS : 0.7
    European -> DMY SP HMS FRAC : 0.3
    MonthDay -> MON SP INT SP HMS : 0.8
    MonthDay -> MON SP INT SP HMS FRAC : 0.2
    Dated -> WDAY SP MON SP INT SP HMS FRAC SP INT : 0.6
    Dated -> WDAY SP MON SP INT SP HMS SP INT : 0.4
    Seconds -> EPOCH FRAC : 1
    Compact -> GLOG SP HMS FRAC : 1

    # Fields
    Level -> LEVEL : 1
    Letter -> LETTER : 1
    Component -> NAME : 1
    Thread -> [ Inside ] : 1
    Inside -> Part : 0.6
    Inside -> Inside Part : 0.4
    Part -> NAME : 0.4
    Part -> INT : 0.2
    Part -> SP : 0.1
    Part -> : : 0.1
    Part -> # : 0.1
    Part -> / : 0.1
    Part -> - : 0.1
    Host -> NAME : 0.8
    Host -> Dotted : 0.2
    Dotted -> INT FRAC : 0.5
    Dotted -> Dotted FRAC : 0.5
    Place -> NAME ( INT ) : 0.7
    Place -> NAME : 0.3

    # Layouts
    Boot -> Stamp SP Level SP INT SP DASHES SP Thread SP Component SP : : 1
    Bracketed -> Stamp SP Level SP Thread SP Component SP - : 1
    Threaded -> Stamp SP Thread SP Level SP Component SP - : 1
    Boxed -> [ Stamp ] SP Level SP Component : : 0.4
    Boxed -> [ Stamp ] SP Level : : 0.2
    Boxed -> [ Stamp ] SP Level SP : 0.3
    Boxed -> [ Stamp ] SP : 0.1
    Named -> Stamp SP Level SP Component : : 1
    Dashed -> Stamp SP - SP Component SP - SP Level SP - : 1
    Tagged -> TL Level SP TD Stamp SP TF Place SP TFN Component SP TT NAME SP TC NAME SP TR : 0.5
    Tagged -> TD Stamp SP TL Level SP TC NAME SP TF Place SP TFN Component SP TT NAME SP TR : 0.5
    Workflow -> Iso SP Mark : 0.5
    Workflow -> Iso SP : 0.5
    Mark -> MARK : 1
    Lettered -> Compact SP INT SP Component : INT ] : 1
    Server -> [ Dated ] SP [ Component : Level ] SP [ NAME SP INT ] : 0.7
    Server -> [ Dated ] SP [ Component : Level ] : 0.3
    Piped -> European SP | SP Level SP | SP Component SP | : 1
    Syslog -> Priority MonthDay SP Host SP Component [ INT ] : : 0.4
    Syslog -> MonthDay SP Host SP Component [ INT ] : : 0.4
    Syslog -> Priority MonthDay SP Host SP Component : : 0.1
    Syslog -> MonthDay SP Host SP Component : : 0.1
    Priority -> PRI : 1
    Counted -> Seconds SP Letter SP Component : : 1
    Plain -> Stamp SP Level SP : 0.6
    Plain -> Stamp SP : 0.4

    # Structured lines
    Json -> { Members } : 1
    Members -> Member : 0.5
    Members -> Members , Member : 0.5
    Member -> KTS : Time : 0.2
    Member -> KLV : Grade : 0.2
    Member -> KFN : Function : 0.2
    Member -> KLG : Logger : 0.2
    Member -> KMS : Text : 0.2
    Member -> KEY : Value : 0.2
    Time -> Value : 1
    Grade -> Value : 1
    Function -> Value : 1
    Logger -> Value : 1
    Text -> Value : 1
    Value -> STR : 0.5
    Value -> NUM : 0.2
    Value -> LIT : 0.1
    Value -> Object : 0.1
    Value -> List : 0.1
    Object -> { } : 0.3
    Object -> { Inner } : 0.7
    Inner -> Field : 0.5
    Inner -> Inner , Field : 0.5
    Field -> AnyKey : Value : 1
    AnyKey -> KEY : 0.5
    AnyKey -> KTS : 0.1
    AnyKey -> KLV : 0.1
    AnyKey -> KFN : 0.1
    AnyKey -> KLG : 0.1
    AnyKey -> KMS : 0.1
    List -> < > : 0.3
    List -> < Values > : 0.7
    Values -> Value : 0.5
    Values -> Values , Value : 0.5
    Pairs -> Pair : 0.4
    Pairs -> Pairs SP Pair : 0.6
    Pair -> KTS EQ Time : 0.2
    Pair -> KLV EQ Grade : 0.2
    Pair -> KFN EQ Function : 0.2
    Pair -> KLG EQ Logger : 0.2
    Pair -> KMS EQ Text : 0.2
    Pair -> KEY EQ Value : 0.2
    Pair -> KEY EQ : 0.1
    Value -> QUO : 0.5
    Value -> BARE : 0.5
    """,
    "Line",
    also={
        "LEVEL": (("NAME", 0.3),),
        "MON": (("NAME", 0.3),),
        "WDAY": (("NAME", 0.3),),
        "LETTER": (("NAME", 0.3),),
        "TEE": (("NAME", 0.1),),
        "ZED": (("NAME", 0.1),),
        "EPOCH": (("INT", 0.5),),
    },
)
ROLES = frozenset("Stamp Iso European MonthDay Dated Seconds Compact Level Letter Component Priority Mark Time Grade Function Logger Text".split())
#: Escape sequences of terminals; they and control characters are never part of a value.
_ESCAPES = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b.")
_CONTROLS = re.compile(r"[\x00-\x08\x0a-\x1f\x7f-\x9f​-‏‪-‮⁠﻿]")
_FIRST_PAIR = re.compile(r"[@\w.-]+=")
_LEADING_MARK = re.compile(r"^(?:##\[\w+\]|::(?:error|warning|notice|debug)(?: [^:]*)?::)\s*")
_UNESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.DOTALL)
_ISO = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ]+(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:?\d\d)?$")
def visible(raw: str) -> str:
    """``raw`` without escape sequences and control characters; tabs stay."""
    return raw if raw.isprintable() else _CONTROLS.sub("", _ESCAPES.sub("", raw))


def _text_tokens(text: str, places: list[tuple[int, int]]) -> Iterator[str]:
    """Token classes of free text, one by one as the parser asks for them; ``places`` grows along."""
    place = places.append
    for m in _TEXT.finditer(text):
        kind = m.lastgroup
        place(m.span())
        if kind == "NAME":
            yield "LEVEL" if m[0].lower() in LEVELS else kind
        else:
            yield m[0] if kind == "CHAR" else kind


def _json_tokens(text: str, places: list[tuple[int, int]]) -> list[str]:
    kinds, found = [], [m for m in _JSON.finditer(text) if m.lastgroup != "WS"]
    for i, m in enumerate(found):
        kind = m.lastgroup
        if kind == "CHAR":
            kind = {"[": "<", "]": ">"}.get(m[0], m[0])
        elif kind == "STR" and i + 1 < len(found) and found[i + 1][0] == ":" and kinds and kinds[-1] in "{,":
            kind = KEY_CLASS.get(m[0][1:-1].lower(), "KEY")
        kinds.append(kind)
        places.append(m.span())
    return kinds


def _pair_tokens(text: str, places: list[tuple[int, int]]) -> list[str]:
    kinds = []
    for m in _PAIRS.finditer(text):
        kind = m.lastgroup
        if kind == "KEY":
            kind = KEY_CLASS.get(m[0].lower(), "KEY") if not kinds or kinds[-1] == "SP" else "BARE"
        kinds.append(m[0] if kind == "CHAR" else kind)
        places.append(m.span())
    return kinds


def plain_value(token: str) -> str:
    """A structured value without its quotes and escapes."""
    if len(token) > 1 and token[0] == token[-1] == '"':
        try:
            got = json.loads(token)
            return got if isinstance(got, str) else token
        except ValueError:
            pass
    if len(token) > 1 and token[0] == token[-1] and token[0] in "\"'":
        same = {"n": "\n", "t": "\t", "r": "\r"}
        return _UNESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else same.get(m[1], m[1]), token[1:-1])
    return token


def _fraction(digits: str | None) -> int:
    return int(((digits or "") + "000000")[:6])


@lru_cache(maxsize=4096)
def _midnight(y: int, m: int, d: int) -> int | None:
    try:
        return micros_of(datetime(y, m, d))
    except ValueError:
        return None


def _clock(hms: str) -> int:
    return (int(hms[:2]) * 3600 + int(hms[3:5]) * 60 + int(hms[6:8])) * 1_000_000


def _iso_us(text: str) -> int | None:
    if not (m := _ISO.match(text)):
        return None
    day = _midnight(int(m[1]), int(m[2]), int(m[3]))
    if day is None:
        return None
    us = day + (int(m[4]) * 3600 + int(m[5]) * 60 + int(m[6])) * 1_000_000 + _fraction(m[7])
    if (z := m[8]) and z != "Z":
        us -= (int(z[1:3]) * 60 + int(z[-2:])) * 60_000_000 * (-1 if z[0] == "-" else 1)
    return us


def _count_us(text: str) -> int | None:
    """A bare count since 1970: seconds, milli-, micro- or nanoseconds by its length."""
    if not (m := re.match(r"(\d{9,19})(?:\.(\d+))?$", text)):
        return None
    whole, part = m[1], m[2] or ""
    scale = 0 if len(whole) <= 11 else 3 if len(whole) <= 14 else 6 if len(whole) <= 17 else 9
    keep = len(whole) - scale + 6
    return int((whole + part + "0" * 12)[:keep])


def _time_us(role: str, text: str, year: int) -> int | None:
    if role in ("Stamp", "Iso"):
        return _iso_us(text)
    if role == "Seconds":
        return _count_us(text)
    if role == "European":
        return _iso_us(f"{text[6:10]}-{text[3:5]}-{text[:2]} {text[10:].strip()}")
    if role == "Compact":
        day = _midnight(year, int(text[1:3]), int(text[3:5]))
        clock, frac = text[5:].strip().split(".") if "." in text else (text[5:].strip(), "")
        return None if day is None else day + _clock(clock) + _fraction(frac)
    words = text.split()
    if role == "Dated":
        words, year = words[1:4], int(words[4])
    day = _midnight(year, MONTHS[words[0].lower()[:3]], int(words[1])) if words[1].isdigit() else None
    clock, _, frac = words[2].replace(",", ".").partition(".")
    return None if day is None else day + _clock(clock) + _fraction(frac)


def read_header(raw: str | None, year: int) -> tuple[int, str, str, str, str] | None:
    """``(entry_us, log_level, component, message, unparsed)`` if ``raw`` opens an entry, else None.

    Lines whose best parse is a continuation open none.  ``unparsed`` is what the best parse
    leaves over though a rule began to explain it: for structured lines the text after the
    last field, for others the part of the message that looked like further fields.
    """
    if not raw:
        return None
    text = visible(raw)
    places: list[tuple[int, int]] = []
    if text[:1] == "{":
        layout, kinds = "fields", _json_tokens(text, places)
    elif "=" in text and _FIRST_PAIR.match(text):
        layout, kinds = "fields", _pair_tokens(text, places)
    else:
        layout, kinds = "text", _text_tokens(text, places)
    found, reach = LAYOUTS.parse(kinds)
    if found is None:
        return None
    if found.notes is None:
        tree = found.accepted[1]
        found.notes = () if tree[3][0][0] == "Continuation" else spans(tree, ROLES)
    if not found.notes:
        return None
    last = found.depth
    entry: int | None = None
    level = component = logger = ""
    message: str | None = None
    for role, a, b in found.notes:
        got = text[places[a][0] : places[b - 1][1]]
        if role == "Level":
            level = LEVELS[got.lower()]
        elif role == "Letter":
            level = LETTERS[got]
        elif role == "Priority":
            level = SEVERITIES[int(got[1:-1]) & 7]
        elif role == "Mark":
            level = MARKS.get(re.sub(r"[^a-z]", " ", got.lower()).split()[0], "")
        elif role == "Component":
            component = got
        elif role == "Time":
            value = plain_value(got).strip()
            entry = _iso_us(value) if (us := _count_us(value)) is None else us
        elif role == "Grade":
            value = plain_value(got).strip()
            level = LEVELS.get(value.lower()) or LETTERS.get(value.upper(), "")
        elif role == "Function":
            component = plain_value(got)
        elif role == "Logger":
            logger = plain_value(got)
        elif role == "Text":
            message = plain_value(got)
        else:
            entry = _time_us(role, got, year)
            if role == "Compact":
                level = LETTERS.get(got[0], "")
    if entry is None:
        return None
    end = places[last - 1][1]
    if layout == "fields":
        if message is None and not level:
            return None
        unparsed, body = text[end:].strip(), message or ""
    else:
        unparsed, body = text[end : places[reach - 1][1]].strip(), text[end:]
    body = _LEADING_MARK.sub("", visible(body).strip())
    return entry, level, (component or logger).strip(), body, unparsed
