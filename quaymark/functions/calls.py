"""Tool calls that a planner wrote into its text, and evidence as text for the one who words the answer."""

from __future__ import annotations

import json
import re
from typing import Any

from quaymark.functions import compact

_WRAPPED = re.compile(r"<tool_call>(.*?)(?:</tool_call>|\Z)", re.S)
_FUNCTION = re.compile(r"<function=([^>]+)>(.*?)(?=</function>|<function=|\Z)", re.S)
_PARAMETER = re.compile(r"<parameter=([^>]+)>(.*?)(?=</parameter>|<parameter=|\Z)", re.S)


def typed(raw: str) -> Any:
    """A value by what it looks like: JSON where it is JSON (in any case for true, false, null), else the text itself."""
    text = raw.strip()
    try:
        return json.loads({"none": "null"}.get(text.lower(), text.lower()) if text.lower() in ("true", "false", "null", "none") else text)
    except ValueError:
        return text


def _object(block: str) -> tuple[str, dict[str, Any]] | None:
    """A call written as a JSON object with a name. Arguments that can't be read, or aren't an object, are none."""
    try:
        given = json.loads(block)
    except ValueError:
        return None
    if not isinstance(given, dict) or not given.get("name"):
        return None
    arguments = given.get("arguments", given.get("parameters"))
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except ValueError:
            arguments = None
    return str(given["name"]), arguments if isinstance(arguments, dict) else {}


def found(text: str | None) -> list[tuple[str, dict[str, Any]]]:
    """(name, arguments) of each call, in order: JSON objects within tool_call tags, or function and parameter tags within them or alone. JSON without tags is no call. A block that the text's end cuts off counts."""
    text, out = text or "", []
    for block in _WRAPPED.findall(text) or [text]:
        call = _object(block.strip()) if block is not text else None
        if call:
            out.append(call)
        else:
            out += [(name.strip(), {k.strip(): typed(v) for k, v in _PARAMETER.findall(body)}) for name, body in _FUNCTION.findall(block)]
    return out


def evidence(trace: list[dict[str, Any]]) -> str:
    """The steps of a trace as numbered blocks: the call, then its compact result."""
    if not trace:
        return "No tool results were gathered."
    told = [f"[{n}] {t['tool']}({json.dumps(t.get('args') or {}, default=str)})\n{t.get('compact') or compact.payload(t.get('result') or {})}" for n, t in enumerate(trace, 1)]
    return "\n\n".join(told)
