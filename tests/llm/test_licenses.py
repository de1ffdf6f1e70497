import numpy as np

from runloom.llm import licenses
from tests.llm.rows import documents


def brute(text, template, least=0.8):
    """Whether some stretch of twice the template's length holds enough of its shingles."""
    words, own = licenses.words(text), licenses.words(template)
    shingles = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
    at = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    return any(len(shingles & set(at[k : k + len(own)])) >= least * len(shingles) for k in range(len(at)))


def test_passages_are_found_and_others_not(spark):
    rng = np.random.default_rng(0)
    noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    fill = lambda n: " ".join(rng.choice(noise, n))
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((k, f"{fill(int(rng.integers(0, 200)))} {text.upper()} {fill(50)}"))
        want[k] = name
        words = text.split()
        if len(words) > 40:
            words[20] = "changed"
            rows.append((100 + k, fill(30) + " " + " ".join(words)))
            want[100 + k] = name
    rows += [(900, fill(500)), (901, ""), (902, None), (903, "licensed under the"), (904, "version 2.0 of the license and the terms")]
    got = licenses.scan(documents(spark, rows), licenses.TEMPLATES).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.license)
    for i, t in rows:
        assert found.get(i, set()) == {n for n, x in licenses.TEMPLATES.items() if brute(t or "", x)}, i
        assert i not in want or want[i] in found[i]
    exact = next(r for r in got if r.doc_id == 0)
    assert dict(rows)[0][exact.start : exact.end].lower() == licenses.TEMPLATES["apache-2.0"].lower().rstrip(".")
    assert licenses.scan(documents(spark, [])).count() == 0


def test_short_templates_and_repeats(spark):
    got = licenses.scan(documents(spark, [(1, "Say: free beer! And FREE-BEER again.")]), {"beer": "free beer"}).collect()
    assert [(r.start, r.end, r.containment) for r in got] == [(5, 14, 1.0), (20, 29, 1.0)]


def damaged(rng, text, share):
    words = text.split()
    for k in rng.choice(len(words), int(share * len(words)), replace=False):
        words[k] = "damaged"
    return " ".join(words)


def test_bands_retrieve_what_is_held():
    """Over damaged templates in noise: windows that hold 0.8 of a template share a band with it, whatever else was looked
    up; and those that ``scan`` signs are all windows with an equal band."""
    rng = np.random.default_rng(5)
    scanner = licenses.Scanner(licenses.TEMPLATES | licenses.WHOLE)
    held = retrieved = 0
    for _ in range(40):
        name = str(rng.choice(list(scanner.own)))
        noise = [f"n{x}" for x in rng.integers(0, 900, 300)]
        text = " ".join([*noise[:150], damaged(rng, (licenses.TEMPLATES | licenses.WHOLE)[name], float(rng.choice([0, 0.01, 0.03]))), *noise[150:]])
        hashes = scanner.shingles.of(text)
        for group in scanner.groups:
            longest, size, names, signatures, _ = group
            every = licenses.Shingles.joined(hashes, size)
            want = set()
            for low, high in scanner.windows(len(every), longest):
                bands = scanner.bands_of(every[low:high])
                for t, signature in zip(names, signatures, strict=True):
                    share = len(np.intersect1d(scanner.own[t], every[low:high])) / len(scanner.own[t])
                    same = bool((signature == bands).any())
                    held, retrieved = held + (share >= 0.8), retrieved + (share >= 0.8 and same)
                    if same:
                        want.add((t, low, high))
            assert set(scanner._retrieved(every, [group])) == want
    assert held >= 60 and retrieved == held


def test_whole_licences_and_long_texts(monkeypatch):
    scanner = licenses.Scanner(licenses.TEMPLATES | licenses.WHOLE | licenses.SHORT)
    text = "Some words. " + licenses.WHOLE["mit-whole"] + " More words."
    found = {f[0] for f in scanner.scan(text)}
    assert {"mit-whole", "mit-text"} <= found and not found & {"isc-whole", "bsd-2-whole"}
    rng = np.random.default_rng(1)
    noise = " ".join(f"w{x}" for x in rng.integers(0, 500, 4000))
    long = noise + "\n" + licenses.WHOLE["isc-whole"] + " " + noise + " All rights reserved. İé " + noise
    want = scanner.scan(long)
    monkeypatch.setattr(licenses, "PIECE", 3000)
    got = scanner.scan(long)
    assert [f[0] for f in got] == [f[0] for f in want] and {f[0] for f in got} >= {"isc-whole", "isc-text", "reserved-short"}
    for name, start, end, share in got:
        assert share >= 0.8 and (name != "reserved-short" or long[start:end] == "All rights reserved")
