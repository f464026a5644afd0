"""Disguises in texts that hold nothing else: scan() finds what the transducers rewrite."""

from __future__ import annotations

import pyarrow as pa
import pytest

from lakemill.llm import op10_pii as P


@pytest.mark.parametrize(
    "hidden, kind",
    [
        ("jane ( at ) example.com", "email"),
        ("jane [ at ] example.com", "email"),
        ("jane <at> example.com", "email"),
        ("jane{ AT }example.com", "email"),
        ("jane at example.com", "email"),
        ("jane\tat\nexample.com", "email"),
        ("jane at example dot com", "email"),
        ("jane (at) example [.] com", "email"),
        ("jane @ example.com", "email"),
        ("plus 44 20 7946 0958", "phone"),
        ("Plus  44 20 7946 0958", "phone"),
        ("plus 44 dot 20 dot 7946 dot 0958", "phone"),
        ("192 dot 168 dot 0 dot 1", "ip"),
        ("192[.]168[.]0[.]1", "ip"),
        ("192 (dot) 168.0 [ dot ] 1", "ip"),
        ("plus oh oh oh oh one oh oh oh oh oh", "phone"),
    ],
)
def test_disguise_alone(hidden, kind):
    for text in (hidden, f"see: {hidden} , so it is"):
        out = P.scan(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]))
        at = text.index(hidden)
        assert out[5].to_pylist() == [f"{kind}:{at}:{at + len(hidden)}"] and out[6].to_pylist() == [1]


@pytest.mark.parametrize("text", ["we met at home. Then we left", "a plus b", "version 3 dot 5 of it", "at 5.30 we left it", "two or three one", "polka dot dress"])
def test_plain_text_is_left_alone(text):
    assert P.scan(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]))[5].to_pylist() == [""]
