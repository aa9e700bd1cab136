import pytest

from millrace.llm import pseudonyms as P

CARD, SPACED, OTHER = "4111111111111111", "4111 1111 1111 1111", "4532015112830366"


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (f"{CARD} 2 items", [CARD]),
        (f"{SPACED} 123", [SPACED]),
        (f"{SPACED} 2 of 3", [SPACED]),
        (f"{CARD} {OTHER}", [CARD, OTHER]),
        (f"{SPACED} 4532 0151 1283 0366", [SPACED, "4532 0151 1283 0366"]),
        ("7536784127813050 4845168114407329", ["7536784127813050", "4845168114407329"]),
        ("378282246310005 12", ["378282246310005"]),
        (f"{CARD}-7", [CARD]),
        ("AT611904300234573201 OK", ["AT611904300234573201"]),
        ("ES9121000418450200051332 2024", ["ES9121000418450200051332"]),
        ("GB82 WEST 1234 5698 7654 32 PAID", ["GB82 WEST 1234 5698 7654 32"]),
        ("NO93 8601 1117 947 AND DE89370400440532013000 X1", ["NO93 8601 1117 947", "DE89370400440532013000"]),
    ],
)
def test_values_before_digits_or_capitals(text, values):
    new, spans = P.Pseudonymiser(b"key").apply(text)
    assert [text[s[1] : s[2]] for s in spans] == values
    assert not any(v in new for v in values)


@pytest.mark.parametrize("text", ["41111111111111111", "4111111111111112 2", "AT611904300234573201X", "AT61190430023457320 OK", "1234567890123456789012"])
def test_longer_runs_stay(text):
    assert P.Pseudonymiser(b"key").apply(text) == (text, [])
