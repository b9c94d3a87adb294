import pytest
from pyspark.sql import functions as F

from loamline.functions import http


def handled(spark, raw):
    return http.handle(spark.createDataFrame([(raw,)], "raw string")).first()


def message(line="POST /message HTTP/1.1", fields=(), text="hello"):
    return "\r\n".join([line, *fields]) + "\r\n\r\n" + text


def test_valid_request(spark):
    r = handled(spark, message(fields=["Host: a", "Host: b", "none", "X:  two", "host: c", "Content-Length: 5"], text="hé"))
    assert (r["method"], r["path"], r["version"], r["body"], r["valid"]) == ("POST", "/message", "HTTP/1.1", "hé", True)
    assert r["headers"] == {"Host": "b", "X": " two", "host": "c", "Content-Length": "5"}
    assert r["response"] == "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: 13\r\nConnection: close\r\n\r\nReceived: hé"


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (message("GET /", text=""), http.BAD_LINE),
        (message("GET / HTTP/2.0"), http.BAD_VERSION),
        (message("GET /", ["Host: x"]), http.BAD_VERSION),
        (message(fields=["Content-Length: abc"]), http.BAD_LENGTH),
        (message(fields=["Content-Length: 1048577"]), http.BODY_TOO_LARGE),
        (message(fields=["Content-Length: -1"]), http.BODY_TOO_LARGE),
        (message(fields=["X: " + "y" * 9000]), http.HEADERS_TOO_LARGE),
        ("", http.BAD_LINE),
        (None, http.BAD_LINE),
    ],
)
def test_errors(spark, raw, error):
    r = handled(spark, raw)
    assert (r["error"], r["valid"], r["route"], r["status"]) == (error, False, "bad request", "400 Bad Request")


@pytest.mark.parametrize(("text", "wanted"), [("+5", 5), ("12abc", 12), (" 7", 7)])
def test_content_length(spark, text, wanted):
    raw = F.lit(message(fields=["X-Content-Length:" + text]))
    assert spark.range(1).select(http.content_length(raw)).first()[0] == wanted


@pytest.mark.parametrize(("line", "status"), [("GET / HTTP/1.0", "200 OK"), ("GET /about HTTP/1.1", "200 OK"), ("GET /?q HTTP/1.1", "404 Not Found"), ("POST / HTTP/1.1", "404 Not Found")])
def test_routes(spark, line, status):
    assert handled(spark, message(line))["status"] == status
