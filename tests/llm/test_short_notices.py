"""Short notices with a changed word are found, whichever it is."""

import numpy as np

from pairspark.llm import license_scan


def test_every_changed_word_of_short_templates():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        words = [w.decode() for w in license_scan.words_of(text.encode())]
        if not 5 <= len(words) <= 15:
            continue
        for place in range(len(words)):
            changed = " ".join("zzz" if i == place else w for i, w in enumerate(words))
            found = license_scan.scan_text(f"one two {changed} three".encode(), index)
            assert name in [f[0] for f in found], (name, place)


def test_another_wording_of_the_mit_line():
    index = license_scan.Index(license_scan.TEMPLATES)
    (found,) = license_scan.scan_text(b"Licensed under the MIT License.", index)
    assert found[:2] == ("MIT", 0.8)


def whole_alignment(pattern, text):
    """Matched words and span of the best local alignment over the whole text; the first of equal ones."""
    best, rows = (0, 0, 0, 0), [(0, 0, j) for j in range(len(text) + 1)]
    for word in pattern:
        now = [(0, 0, 0)]
        for j, other in enumerate(text):
            hit = word == other
            s, m, a = rows[j] if rows[j][0] > 0 else (0, 0, j)
            options = [(s + (2 if hit else -1), m + hit, a), (rows[j + 1][0] - 1, *rows[j + 1][1:]), (now[j][0] - 1, *now[j][1:])]
            top = max(options, key=lambda o: o[0])
            now.append(top if top[0] > 0 else (0, 0, j + 1))
            if top[0] > best[0]:
                best = (top[0], top[1], top[2], j + 1)
        rows = now
    return best[1:]


def test_one_notice_per_text_against_whole_alignments():
    """Every notice, changed in up to a tenth of its words, is found with the coverage and span of an alignment without index and band."""
    rng = np.random.default_rng(3)
    index = license_scan.Index(license_scan.TEMPLATES)
    split = {name: license_scan.words_of(text.encode()) for name, text in license_scan.TEMPLATES.items()}
    for name, words in split.items():
        filler = [b"w%d" % rng.integers(1000) for _ in range(30)]
        changed = list(words)
        for at in rng.choice(len(words), len(words) // 10, replace=False):
            changed[at] = b"zzz"
        text = [*filler[:11], *changed, *filler[11:]]
        want = []
        for other, pattern in split.items():
            matched, a, b = whole_alignment(pattern, text)
            if matched >= license_scan.COVERAGE * len(pattern):
                want.append((other, matched / len(pattern), a, b, matched / max(len(pattern), b - a)))
        want = license_scan.closest(sorted(want))
        assert name in [w[0] for w in want]
        assert license_scan.scan_text(b" ".join(text), index) == want, name


def test_related_licenses_are_told_apart():
    index = license_scan.Index(license_scan.TEMPLATES)
    for line, name in [(b"Licensed under the GNU Lesser General Public License v3.", "LGPL-3.0"), (b"// SPDX-License-Identifier: LGPL-3.0-only", "SPDX-LGPL-3.0-only"),
                       (b"This is free and unencumbered software released into the public domain.", "Unlicense"), (b"# SPDX-License-Identifier: MIT", "SPDX-MIT"),
                       (license_scan.TEMPLATES["AGPL-3.0-or-later-header"].encode(), "AGPL-3.0-or-later-header")]:
        assert [f[0] for f in license_scan.scan_text(b"so it is. " + line + b" And on.", index)] == [name]
