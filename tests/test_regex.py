"""Regex detectors: own cases by rule, offsets and span properties."""

import re

import pytest
from conftest import run

FOUND = [
    ("email", "write to ana.b+tag@mail.sub.example.org, soon", ["ana.b+tag@mail.sub.example.org"]),
    ("email", "two: x_1@y-z.io;q%9@w.net", ["x_1@y-z.io", "q%9@w.net"]),
    ("ipv4", "from 10.20.30.40 to 255.0.255.1", ["10.20.30.40", "255.0.255.1"]),
    ("ipv4", "no boundary 300.7.8.9", ["00.7.8.9"]),
    ("us-social-security-number", "id 987-65 4321 or 900 11-2233", ["987-65 4321", "900 11-2233"]),
    ("uk-post-code", "to EC2V 7HH and M11AE", ["EC2V 7HH", "M11AE"]),
    ("us-phone-number", "ring (646) 555-0142 or 646.555.0199", ["(646) 555-0142", "646.555.0199"]),
    ("us-phone-number", "ring +1 646 555 0142", ["+1 646 555 0142"]),
]
ABSENT = [
    ("email", "ana@host and ana@host.x or @host.org"),
    ("ipv4", "1.2.3 and 1,2,3,4"),
    ("us-social-security-number", "987654321 987-654-321"),
    ("uk-post-code", "ec2v 7hh"),
    ("us-phone-number", "6465550142"),
]
# Prefixes and lengths of card numbers, with the groups they are printed in.
CARDS = [("4", (4, 4, 4, 4)), ("52", (4, 4, 4, 4)), ("34", (4, 6, 5)), ("6011", (4, 4, 4, 4)), ("300", (4, 6, 4)), ("3528", (4, 4, 4, 4))]


def card(prefix, groups, seed):
    """A number of a prefix that passes the Luhn check, as groups of digits."""
    size = sum(groups)
    digits = [int(c) for c in prefix] + [(seed * 7 + i * i * 3) % 10 for i in range(size - len(prefix) - 1)]
    doubled = [d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))]
    text = "".join(map(str, digits)) + str(-sum(doubled) % 10)
    ends = [sum(groups[: i + 1]) for i in range(len(groups))]
    return [text[e - g : e] for e, g in zip(ends, groups)]


def test_found(spark):
    for name, text, want in FOUND:
        assert [d["text"] for d in run(spark, [text], {"regex": [name]})[0]] == want, (name, text)


def test_absent(spark):
    for name, text in ABSENT:
        assert run(spark, [text], {"regex": [name]})[0] == [], (name, text)


def test_cards(spark):
    good, bad = [], []
    for seed, (prefix, groups) in enumerate(CARDS):
        parts = card(prefix, groups, seed)
        good += [sep.join(parts) for sep in ("", " ", "-")]
        last = parts[-1][:-1] + str((int(parts[-1][-1]) + 1) % 10)
        bad += [" ".join([*parts[:-1], last]), "-".join(parts[:-1]), " ".join(parts[:2]) + "-" + " ".join(parts[2:])]
    res = run(spark, [f"paid with {c}." for c in good + bad], {"regex": ["credit-card"]})
    assert [[d["text"] for d in r] for r in res[: len(good)]] == [[c] for c in good]
    assert res[len(good) :] == [[]] * len(bad)


def test_offsets_and_order(spark):
    res = run(spark, ["Hi my email is abc@def.com", "There is a party@my house and you can reach me at 123-456-7890"], {"regex": ["email", "us-phone-number"]})
    assert [(d["start"], d["end"], d["text"], d["detection"]) for d in res[0]] == [(15, 26, "abc@def.com", "email_address")]
    assert [(d["start"], d["end"], d["text"], d["detection"]) for d in res[1]] == [(50, 62, "123-456-7890", "us-phone-number")]
    assert res[0][0]["evidences"] is None and res[0][0]["score"] == 1.0


def test_multiple_in_request_order(spark):
    res = run(spark, ["Email: a@b.com, SSN: 123-45-6789"], {"regex": ["us-social-security-number", "email"]})[0]
    assert [d["detection"] for d in res] == ["social_security_number", "email_address"]


def test_custom_regex_and_placeholder(spark):
    res = run(spark, ["foo bar baz"], {"regex": ["ba.", "$CUSTOM_REGEX"]})[0]
    assert [(d["text"], d["detection"], d["detection_type"]) for d in res] == [("bar", "custom-regex", "regex"), ("baz", "custom-regex", "regex")]


def test_unknown_name_is_a_pattern(spark):
    assert run(spark, ["zip 12345"], {"regex": ["us-zip-code"]})[0] == []


@pytest.mark.parametrize("bad", ["[", "(unclosed group"])
def test_bad_pattern_raises_on_driver(spark, bad):
    with pytest.raises(re.error):
        run(spark, ["x"], {"regex": [bad]})


def test_ipv4_no_word_boundary(spark):
    res = run(spark, ["256.1.1.1"], {"regex": ["ipv4"]})[0]
    assert [d["text"] for d in res] == ["56.1.1.1"]


def test_ipv6_python_path(spark):
    res = run(spark, ["::ffff:192.168.1.1", "no colon here", "addr 2001:db8:0:0:0:0:2:1 end"], {"regex": ["ipv6"]})
    assert [d["text"] for d in res[0]] == ["::ffff:192.168.1.1"]
    assert res[1] == []
    assert [d["text"] for d in res[2]] == [" 2001:db8:0:0:0:0:2:1 "]


def test_unicode_offsets_are_code_points(spark):
    text = "😀 é a@b.com x ١٢٣-٤٥-٦٧٨٩"
    res = run(spark, [text], {"regex": ["email", "us-social-security-number"]})[0]
    for d in res:
        assert text[d["start"]: d["end"]] == d["text"]
    assert [d["detection"] for d in res] == ["email_address", "social_security_number"]


def test_null_text_gives_empty(spark):
    from sievekit.plans.detect import detect

    df = spark.createDataFrame([(1, None)], "content_id long, text string")
    r = detect(df, {"regex": ["email"]}).collect()[0]
    assert r["detections"] == []
