"""HTTP-style messages as column expressions: parse, validate, route, render. No shuffle, no Python code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.text import or_default

# The limits and texts of the protocol side.
HEADER_BYTES, BODY_BYTES = 8192, 1048576
VERSIONS = ["HTTP/1.0", "HTTP/1.1"]
HEADERS_TOO_LARGE = "Request headers too large"
BODY_TOO_LARGE = "Request body too large"
BAD_LENGTH = "Invalid Content-Length"
BAD_LINE = "Malformed request line"
BAD_VERSION = "Unsupported HTTP version"
BAD_REQUEST = "Invalid HTTP request"
HOME, ABOUT, RECEIVED, NOT_FOUND = "Hello from C++", "About page", "Received: ", "route not found"


def head(raw: Column) -> Column:
    """The message up to its first blank line; the whole of it without one."""
    at = F.instr(raw, F.lit("\r\n\r\n"))
    return F.when(at > 0, F.substr(raw, F.lit(1), at - 1)).otherwise(raw)


def body(raw: Column) -> Column:
    """All behind the first blank line, not cut to Content-Length."""
    at = F.instr(raw, F.lit("\r\n\r\n"))
    return F.when(at > 0, F.substr(raw, at + 4)).otherwise("")


def content_length(raw: Column) -> Column:
    """The number behind the first ``Content-Length:`` anywhere in the head: 0 without one, null if it is no number."""
    top = head(raw)
    at = F.instr(top, F.lit("Content-Length:"))
    digits = F.regexp_extract(F.substr(top, at + 15), r"^\s*([+-]?\d+)", 1)
    number = F.nullif(digits, F.lit("")).try_cast("decimal(20,0)")
    return F.when(at == 0, F.lit(0).cast("decimal(20,0)")).otherwise(number)


def tokens(raw: Column) -> Column:
    """Words of the whole message between blanks and line ends; the fourth holds the rest."""
    return F.split(F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"\s+", 4)


def headers(raw: Column) -> Column:
    """Header fields as a map: names keep their case, the last of equal names counts, lines without a colon are skipped."""
    lines = F.split(head(raw), "\n")
    lines = F.slice(lines, 2, F.size(lines))
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "\r$", "")), lambda x: F.instr(x, F.lit(":")) > 0)
    fields = F.transform(
        lines,
        lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("key"), F.regexp_replace(F.substr(x, F.instr(x, F.lit(":")) + 1), "^ ", "").alias("value")
        ),
    )
    names = F.array_distinct(F.transform(fields, lambda f: f["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(fields, lambda f: f["key"] == n), -1)["value"])
    return F.map_from_arrays(names, last)


def _first_error(top: Column, length: Column, words: Column) -> Column:
    return (
        F.when(F.octet_length(top) > HEADER_BYTES, HEADERS_TOO_LARGE)
        .when(length.isNull(), BAD_LENGTH)
        .when((length < 0) | (length > BODY_BYTES), BODY_TOO_LARGE)
        .when((F.size(words) < 3) | (F.get(words, F.lit(2)) == ""), BAD_LINE)
        .when(~F.get(words, F.lit(2)).isin(VERSIONS), BAD_VERSION)
        .otherwise("")
    )


def request_error(raw: Column) -> Column:
    """The first thing wrong with a message, empty for a valid one: head size, length, body size, request line, version."""
    return _first_error(head(raw), content_length(raw), tokens(raw))


def parse_requests(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """All columns and method, path, version, headers, body, valid, error. A null message is an empty one.

    An invalid message has no headers and no body; if its head or its length is at fault, no request line either. What
    several fields hang on is worked out once, in projections of its own.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    read = messages.select("*", F.struct(text.alias("text"), head(text).alias("head"), content_length(text).alias("length"), tokens(text).alias("words")).alias("_read"))
    read = read.withColumn("_error", _first_error(F.col("_read.head"), F.col("_read.length"), F.col("_read.words")))
    text, error = F.col("_read.text"), F.col("_error")
    line = lambda i: F.when(error.isin("", BAD_LINE, BAD_VERSION), F.coalesce(F.get(F.col("_read.words"), F.lit(i)), F.lit(""))).otherwise("")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return read.select(
        *[F.col(f"`{c}`") for c in messages.columns], line(0).alias("method"), line(1).alias("path"), line(2).alias("version"), F.when(error == "", headers(text)).otherwise(none).alias("headers"),
        F.when(error == "", body(text)).otherwise("").alias("body"), (error == "").alias("valid"), error.alias("error"),
    )


def route(method: Column, path: Column) -> Column:
    """Which handler takes a request; paths are compared whole, so one with a query is not found."""
    return (
        F.when((method == "GET") & (path == "/"), "home")
        .when((method == "GET") & (path == "/about"), "about")
        .when((method == "POST") & (path == "/message"), "message")
        .otherwise("not found")
    )


def answer(valid: Column, error: Column, method: Column, path: Column, sent: Column) -> tuple[Column, Column]:
    """(status, body) of the response to a request."""
    to = route(method, path)
    status = F.when(~valid, "400 Bad Request").when(to == "not found", "404 Not Found").otherwise("200 OK")
    text = (
        F.when(~valid, or_default(error, BAD_REQUEST))
        .when(to == "home", HOME)
        .when(to == "about", ABOUT)
        .when(to == "message", F.concat(F.lit(RECEIVED), sent))
        .otherwise(NOT_FOUND)
    )
    return status, text


def render_response(status: Column, text: Column) -> Column:
    """The response message; Content-Length counts bytes."""
    return F.concat(
        F.lit("HTTP/1.1 "), status, F.lit("\r\nContent-Type: text/plain\r\nContent-Length: "), F.octet_length(text).cast("string"),
        F.lit("\r\nConnection: close\r\n\r\n"), text,
    )


def handle(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Requests with route, status and response: parse, route and render in one projection chain."""
    asked = parse_requests(messages, raw)
    status, text = answer(F.col("valid"), F.col("error"), F.col("method"), F.col("path"), F.col("body"))
    asked = asked.withColumn("route", F.when(F.col("valid"), route(F.col("method"), F.col("path"))).otherwise("bad request"))
    return asked.withColumn("status", status).withColumn("response", render_response(status, text))
