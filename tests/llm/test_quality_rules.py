import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from tablewarden.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "é ü ##<|> \x0b x", "x\n\nx\n x\nx\r\nx\r", "\x1c a\x85b  c"]
    out += ["\n".join(" ".join(r.choices("a b cc ddd é # $5".split(), k=r.randint(0, 9))) for _ in range(r.randint(0, 12))) for _ in range(150)]
    return out + ["end of one", "one of end end of one", "w" * 3000 + " x " * 900]


@pytest.mark.parametrize("piece", [7, 64, 2 << 20])
def test_counts(monkeypatch, piece):
    monkeypatch.setattr(quality_rules, "PIECE_BYTES", piece)
    found = quality_rules.counts_of([(t or "").encode() for t in texts()])
    for k, text in enumerate(texts()):
        assert {name: int(c[k]) for name, c in found.items()} == brute(text), repr(text)


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(quality_rules, "mix64", lambda x: x * 0)
    found = quality_rules.counts_of([b"a b c d e f g h", b"a b c x a b c"])
    assert found["n_repeat_words"].tolist() == [0, 6]


SCHEMA = "doc_id long, host string, text string, n_words string, kept int, short string, rate_short int, distrusted string, n int"


def test_hosts_against_brute_force(spark):
    r = random.Random(9)
    good = lambda: " ".join(f"word{r.randint(0, 10**6)}" for _ in range(60))
    bad = lambda: good() + " ####" * 9
    rows, n = [], 0
    for host, failing, clean in [("a", 2, 300), ("farm", 90, 10), ("tiny", 1, 0), (None, 0, 5), ("", 3, 4), ("h", 25, 20)]:
        for text in [bad() for _ in range(failing)] + [good() for _ in range(clean)]:
            n += 1
            rows.append((n, host, text))
    rows += [(n, "a", rows[-1][2]), (None, "a", good()), (n + 1, "a", None), (n + 2, "a", "few words"), (n + 3, "farm", "x y z " * 60)]
    docs = spark.createDataFrame([(*row, "w", 0, "s", 1, "d", 2) for row in rows], SCHEMA).repartition(4)
    got = quality_rules.judged(docs).collect()

    def fails(t):
        c = brute(t)
        return {
            "short": c["n_words"] < 50, "repetitive": 100 * c["n_repeat_words"] > 50 * c["n_words"],
            "symbols": 10 * c["n_symbols"] > c["n_words"], "dup_lines": 10 * c["n_dup_lines"] > 3 * c["n_lines"],
            "word_length": c["word_chars"] < 3 * c["n_words"] or c["word_chars"] > 10 * c["n_words"],
        }

    odd = set()
    for rule, limit in quality_rules.LIMITS.items():
        hosts = {}
        for _, host, text in rows:
            k, m = hosts.get(host, (0, 0))
            hosts[host] = k + fails(text)[rule], m + 1
        total, p = len(rows), Fraction(sum(k for k, _ in hosts.values()), len(rows))
        if p in (0, 1):
            continue
        spread = sum(m * (Fraction(k, m) - p) ** 2 for k, m in hosts.values())
        room = total - Fraction(sum(m * m for _, m in hosts.values()), total) - (len(hosts) - 1)
        rho = (spread / (p * (1 - p)) - (len(hosts) - 1)) / room
        for host, (k, m) in hosts.items():
            weight = max(1 / rho - 1, 0) if rho > 0 else None
            if (p if weight is None else (k + weight * p) / (m + weight)) > limit:
                odd.add(host)
    assert "farm" in odd and "a" not in odd
    want = []
    for i, host, text in rows:
        f = fails(text)
        base = f["short"] or f["repetitive"]
        want.append((i, host, base, host in odd, not base and not (host in odd and any(f.values()))))
    assert sorted(((x.doc_id, x.host, x.base_failed, x.host_distrusted, x.kept) for x in got), key=repr) == sorted(want, key=repr)
    assert sum(w[4] for w in want if w[1] == "farm") == 10


def test_prior():
    assert quality_rules.prior(0, 0, 0.0, 0, 0.0) == (0.0, None)
    assert quality_rules.prior(3, 30, 300.0, 0, 0.0) == (0.0, None) and quality_rules.prior(3, 30, 300.0, 30, 30.0) == (1.0, None)
    assert quality_rules.prior(3, 30, 300.0, 15, 7.5) == (0.5, None)  # hosts alike
    p, weight = quality_rules.prior(2, 20, 200.0, 10, 10.0)  # one host always, one never
    assert p == 0.5 and weight < 0.2


def test_empty_table(spark):
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, host string, text string")).collect() == []
