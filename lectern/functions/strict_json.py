"""Strict JSON: what the JSON grammar allows and nothing else, in Arrow batches.

Spark's own parser also accepts trailing words, single quotes and broken objects.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

PARSED = StructType().add("body", StringType()).add("problem", StringType()).add("error", StringType())


def _parsed(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(canonical form, what is wrong with the JSON, any other error)."""
    try:
        return json.dumps(json.loads(text), separators=(",", ":")), None, None
    except json.JSONDecodeError as bad:
        return None, str(bad), None
    except TypeError:  # no text
        return None, "no text", None
    except (ValueError, RecursionError) as error:  # numbers without end, nesting without end
        return None, None, str(error)


@F.pandas_udf(PARSED)
def parse_json(texts: pd.Series) -> pd.DataFrame:
    """Struct (body, problem, error): the canonical form of a JSON text, or why there is none.

    A text that isn't JSON has a ``problem``; one that can't be read for another reason, as it nests too
    deep, has an ``error``.
    """
    return pd.DataFrame([_parsed(x) for x in texts], columns=["body", "problem", "error"])


# What a client shows of a stream that it can't go on with.
BAD_PAYLOAD, BAD_STREAM = "Failed to parse stream payload", "Stream error occurred"
FRAME = StructType().add("payload", StringType()).add("problem", StringType())


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def frame_payload(event: str | None, data: str | None) -> tuple[str | None, str | None]:
    """(canonical payload, why the stream ends here) of a frame. To a client NaN and infinities are no JSON."""
    try:
        value = json.loads(data, parse_constant=_no_constant)
        payload = json.dumps(value, separators=(",", ":"))
    except (TypeError, ValueError, RecursionError):
        return None, BAD_PAYLOAD
    if event != "error":
        return payload, None
    said = value.get("error") if isinstance(value, dict) else None
    return payload, BAD_STREAM if not said else said if isinstance(said, str) else json.dumps(said, separators=(",", ":"))


@F.pandas_udf(FRAME)
def frame_payloads(events: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Struct (payload, problem) of frames' event names and data."""
    return pd.DataFrame([frame_payload(e, d) for e, d in zip(events, data)], columns=["payload", "problem"])


def strict_json(text):
    """The canonical form of a JSON text; null where it isn't one."""
    return parse_json(text)["body"]


def _shape(text: str | None, wanted: tuple[str, ...]) -> tuple[str | None, str | None, str | None]:
    try:
        value = json.loads(text)
    except (TypeError, ValueError) as bad:
        return None, str(bad), None
    except RecursionError as error:
        return None, None, str(error)
    if not isinstance(value, (dict, list, str)):
        return None, None, f"argument of type '{type(value).__name__}' has no keys"
    if all(x in value for x in wanted):
        return json.dumps(value, separators=(",", ":")), None, None
    return None, "Invalid verdict structure", None


def shaped_json(wanted: tuple[str, ...]):
    """A function of a text column: struct (body, problem, error) of JSON that must contain the keys ``wanted``.

    Presence counts, not the value: null passes. Keys are looked up in lists and strings as well; a number,
    a boolean or null has no keys to look up, which is an ``error``.
    """

    @F.pandas_udf(PARSED)
    def shaped(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_shape(x, wanted) for x in texts], columns=["body", "problem", "error"])

    return shaped


def _flat(content) -> str:
    match content:
        case None:
            return ""
        case str():
            return content
        case list():
            return "".join(map(_flat, content))
        case {"text": str(text)}:
            return text
        case dict():
            return _flat(content.get("content"))
        case _:
            return str(content)


def _flat_json(text: str | None) -> str:
    try:
        return _flat(json.loads(text))
    except (TypeError, ValueError, RecursionError):
        return text or ""


@F.pandas_udf(StringType())
def flat_content(contents: pd.Series) -> pd.Series:
    """The plain text of a model's content, given as JSON: strings, lists of parts, objects with text or content.

    Null is empty; what isn't JSON is text already.
    """
    return contents.map(_flat_json)
