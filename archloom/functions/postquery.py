"""Request bodies as query strings, so that a POST or PUT has a key of its own."""

from __future__ import annotations

import base64
import email.message
import email.parser
import email.policy
import json
from urllib.parse import unquote_plus, urlencode

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST = 4096
UNKNOWN_LENGTH = 8192


def flatten_json(text: str) -> str:
    """Leaves, depth first, as name=value. A leaf is named by the nearest object key, the n-th of a name as name.n_; those without a name are left out."""
    leaves: dict[str, str] = {}
    seen: dict[str, int] = {}

    def walk(value, name: str) -> None:
        stack = [(value, name)]
        while stack:
            v, k = stack.pop()
            if isinstance(v, dict):
                stack += [(x, n) for n, x in reversed(v.items())]
            elif isinstance(v, list):
                stack += [(x, k) for x in reversed(v)]
            elif k:
                seen[k] = seen.get(k, 0) + 1
                leaves[k if seen[k] == 1 else f"{k}.{seen[k]}_"] = str(v)

    try:
        walk(json.loads(text), "")
    except json.JSONDecodeError:
        if "\n" not in text:
            raise
        for line in text.split("\n"):
            walk(json.loads(line), "")
    return urlencode(leaves)


def _multipart(content_type: str, body: bytes) -> str:
    boundary = content_type.split("boundary=", 1)[1].split(";")[0].strip().strip('"').encode()
    fields: dict[str, list[str]] = {}
    for part in (b"\r\n" + body).split(b"\r\n--" + boundary)[1:]:
        if part.startswith(b"--"):
            break
        head, _, value = part.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        m: email.message.Message = email.parser.BytesHeaderParser(policy=email.policy.compat32).parsebytes(head)
        name = m.get_param("name", header="content-disposition")
        if isinstance(name, str):
            fields.setdefault(name, []).append(value.decode("utf-8", "replace"))
    return urlencode(fields, True)


def _binary(body: bytes) -> str:
    return "__wb_post_data=" + base64.b64encode(body).decode()


def query_of(content_type: str | None, length: object, body: bytes | None) -> str | None:
    """The query that stands for a body; None if its length is no number. Only the length that is declared is read."""
    try:
        n = UNKNOWN_LENGTH if length is None else int(length)
    except (ValueError, TypeError):
        return None
    data, mime = (body or b"")[: max(0, n)], content_type or ""
    if mime.startswith("application/x-www-form-urlencoded"):
        try:
            out = unquote_plus(data.decode())
        except UnicodeDecodeError:
            out = _binary(data)
    elif mime.startswith("multipart/"):
        out = _multipart(mime, data) if "boundary=" in mime else _binary(data)
    elif mime.startswith("application/json"):
        try:
            out = flatten_json(data.decode())
        except ValueError:
            out = ""
    elif mime.startswith("text/plain"):
        try:
            out = flatten_json(data.decode())
        except ValueError:
            out = _binary(data)
    else:
        out = _binary(data)
    return out[:MOST]


def url_key(method: str, content_type: str | None, length: object, body: bytes | None, url: str) -> tuple[str | None, str]:
    """(query, URL with the method and the query added)."""
    query = query_of(content_type, length, body) if method in ("POST", "PUT") else ""
    return query, url + ("&" if "?" in url else "?") + f"__wb_method={method}" + (f"&{query}" if query else "")


@F.arrow_udf(StringType())
def url_keys(methods: pa.Array, content_types: pa.Array, lengths: pa.Array, bodies: pa.Array, urls: pa.Array) -> pa.Array:
    columns = (x.to_pylist() for x in (methods, content_types, lengths, bodies, urls))
    return pa.array([None if u is None else url_key(m or "", c, n, b, u)[1] for m, c, n, b, u in zip(*columns)], pa.string())
