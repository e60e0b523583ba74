import math

import pytest

from ancestra.llm import secrets


@pytest.mark.parametrize(
    "text, value",
    [
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ8vLp2Kd0", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ8vLp2Kd0"),
        ("export DB_PASS=hV7p!Qz2kW", "hV7p!Qz2kW"),
        ("SMTP_PWD=Zx9$kQ27vLp", "Zx9$kQ27vLp"),
        ('{"dbPassword": "P@ss9#mQ2$vL"}', "P@ss9#mQ2$vL"),
        ("myDBPassword=P@ss9#mQ2$vL", "P@ss9#mQ2$vL"),
        ("the secret password is Xk9#mQ2$vL", "Xk9#mQ2$vL"),
        ("auth credentials Xk9#mQ2$vL here", "Xk9#mQ2$vL"),
        ("Authorization: Bearer eyJhbGciOiJIUzI1", "eyJhbGciOiJIUzI1"),
        ("auth: Qx7#bW", "Qx7#bW"),
        ("passphrase: gkwqzvhtrm", "gkwqzvhtrm"),
        ("the password is xkqvbnzwtrplmjh", "xkqvbnzwtrplmjh"),
    ],
)
def test_value_of_a_credential_context_is_masked(text, value):
    assert secrets.redacted(text) == text.replace(value, "[SECRET]")


@pytest.mark.parametrize("value", ["administrator-configuration", "configuration2024", "development-environment-1", "some.host.example.org:8080/path", "P@ssw0rd2023!"])
def test_readable_values_are_no_secrets(value):
    assert secrets.spans(f"the access key: {value} here") == []


def test_cost_takes_time_in_proportion():
    """A value is searched whole, however long it is, and not remembered then."""
    value = "ab3$k" * 4000
    assert secrets.guess_cost(value) <= secrets._brute("ab3$k") + math.log10(4000) + secrets.SEGMENT + 1e-9
    assert secrets.spans("key api_key: " + "Zq7$" + "x9K!" * 3 + "w8#" * 2)[-1][2] == "guess"


@pytest.mark.parametrize("text", ["compass Zx9$kQ27vLp", "the pass gkwqzvhtrm", "DB_PASS=letmein", "Authorization: Bearer"])
def test_other_values_stay(text):
    assert [s for s in secrets.spans(text) if s[2] == "guess"] == []
