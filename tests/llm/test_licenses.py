from __future__ import annotations

import random

import pytest

from corvane.llm import licenses
from corvane.llm.queries import op8_licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES)


def test_every_template_finds_itself():
    for name, template in licenses.TEMPLATES.items():
        text = f"Some words before. {template} And some after."
        found = SCANNER.scan(text)
        assert any(n == name and c == 1.0 for n, c, *_ in found) or any(n != name and m >= len(licenses._WORDS.findall(template.lower())) for n, _, _, _, m in found), name
        for _, _, a, b, _ in found:
            assert text[a:b] in text and text[a - 1] in ' "' and b <= len(text)


def words_of(text):
    return licenses._WORDS.findall(text.lower())


def brute_scan(text, scanner=SCANNER):
    """Every template aligned with the whole text, without index and band."""
    ids = [scanner.vocabulary.get(w, 0) for w in words_of(text)]
    found = [(m, s, a, b, k) for k, t in enumerate(scanner.templates) for m, s, a, b in licenses.align(t, ids, -len(t), len(ids), scanner.edits[k])]
    return scanner._spans(text, text.lower(), len(ids), found)


def least_edits(template, words):
    """Edits between a template and its best place in a text, by the plain table."""
    row = [0] * (len(words) + 1)
    for i, t in enumerate(template, 1):
        above, row = row, [i]
        for j, w in enumerate(words, 1):
            row.append(min(above[j - 1] + (t != w), above[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(name):
    """All texts that are one word away from a template (every seventh place of long ones), between other words."""
    words = words_of(licenses.TEMPLATES[name])
    for at in range(0, len(words), 1 if len(words) <= 40 else 7):
        for change in ([], ["zzz"], [words[at], "zzz"]):
            yield "some words " + " ".join(words[:at] + change + words[at + 1 :]) + " and more"


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_single_edit_is_found(name):
    n = len(words_of(licenses.TEMPLATES[name]))
    for text in edited(name):
        found = SCANNER.scan(text)
        assert found and max(m[4] for m in found) >= n - 1, text
        if n <= 40:
            assert found == brute_scan(text), text


@pytest.mark.parametrize("name", ["MIT-line", "CC-BY-SA-4.0-line", "Apache-2.0-line", "GPL-2.0-line", "MPL-2.0", "Apache-2.0", "ISC"])
def test_many_edits_agree_with_brute_force(name):
    """As many edits as are allowed, and one more, at random places: what is found is what the whole table finds."""
    draw = random.Random(name)
    template = words_of(licenses.TEMPLATES[name])
    for round_ in range(12 if len(template) < 60 else 3):
        e = licenses.edits_allowed(len(template)) + round_ % 2
        words = list(template)
        for at in draw.sample(range(len(words)), e):
            words[at] = draw.choice(["", "zzz", f"{words[at]} zzz", f"the {words[at]}"])
        text = "x the " + " ".join(words) + " of this y " + " ".join(template[: len(template) // 2])
        found = SCANNER.scan(text)
        assert found == brute_scan(text), text
        k = SCANNER.names.index(name)
        close = least_edits(template, words_of(text)) <= SCANNER.edits[k]
        assert close <= bool(found)


@pytest.mark.parametrize("n", [*range(1, 60), 120, 250])
def test_needed_hits_are_a_lower_bound(n):
    """Edits at even and at random places leave at least as many kept sequences as a proposal needs."""
    draw, e = random.Random(n), licenses.edits_allowed(n)
    gram, window = licenses.gram_and_window(n, e)
    needed = licenses.hits_needed(n, e, gram, window)
    for round_ in range(20):
        kept = licenses.winnow([draw.randrange(1000) for _ in range(n - gram + 1)], window)
        broken = {int((i + 1) * n / (e + 1)) for i in range(e)} if round_ % 2 else set(draw.sample(range(n), e))
        whole = [i for i in kept if not broken & set(range(i, i + gram))]
        assert len(whole) >= needed


def test_winnowing_guarantee():
    draw = random.Random(1)
    hashes = [draw.randrange(1000) for _ in range(60)]
    kept = licenses.winnow(hashes, 4)
    assert all(any(i <= k < i + 4 for k in kept) for i in range(57))
    assert licenses.winnow([5, 3], 4) == [1] and licenses.winnow([]) == []


def test_repeated_and_odd(spark, odd, empty, clashing):
    line = licenses.TEMPLATES["MIT-line"]
    assert len(SCANNER.scan(f"{line}\n" * 50)) == 50
    assert SCANNER.scan("") == SCANNER.scan("mit " * 1000) == SCANNER.scan("of the " * 5000) == []
    rows = {(r.doc_id): [m.license for m in r.matches] for r in licenses.scan_licenses(odd).collect() if r.matches}
    assert rows == {9: ["Apache-2.0-line"]}
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(clashing).count() == odd.count()
    assert licenses.Scanner({"short": "word"}).scan("a word.")[0][:4] == ("short", 1.0, 2, 6)
    with pytest.raises(ValueError):
        licenses.Scanner({"none": "..."})


def test_query_against_brute_force(spark, sf_dir, few):
    """All one-line templates aligned with all texts of fewer than 4,000 characters; the planted ones are of one line."""
    _, texts = few
    rows = {r.doc_id: r for r in op8_licenses(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    lines = [k for k in SCANNER.names if k.endswith("-line")]
    small = licenses.Scanner({k: licenses.TEMPLATES[k] for k in lines})
    some = [i for i in sorted(texts) if len(texts[i]) < 4000]
    assert len(some) > 100 and any(rows[i].n_matches for i in some)
    for i in some:
        expected = brute_scan(texts[i], small)
        assert rows[i].n_matches == len(expected) and rows[i].spans == ",".join(f"{n}:{a}:{b}" for n, _, a, b, _ in expected)
