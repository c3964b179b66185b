"""Longest previous factors against their definition."""

import random

import numpy as np

from review_insights.llm import lpf_dedup as lpf


def test_common_prefixes():
    rng = random.Random(1)
    rows = sorted(bytes(rng.choice(b"ab\x00\xff") for _ in range(lpf.SPAN)) for _ in range(200))
    rows += [rows[-1], rows[-1][:-1] + b"\xff"]
    rows.sort()
    padded = np.zeros((len(rows), 104), np.uint8)
    padded[:, :lpf.SPAN] = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    found = lpf.common_prefixes(padded.view(">u8"))
    for k in range(1, len(rows)):
        a, b = rows[k - 1], rows[k]
        assert found[k] == next((i for i in range(lpf.SPAN) if a[i] != b[i]), lpf.SPAN)
    assert found[0] == 0 and len(lpf.common_prefixes(padded[:0].view(">u8"))) == 0


def test_factors_by_their_definition():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def common(i, j):
            n = 0
            while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        shared = np.array([0] + [common(a, b) for a, b in zip(order, order[1:])][:max(0, len(order) - 1)], np.int64)[:len(order)]
        found = lpf.longest_previous_factors(np.array(order, np.int64), shared)
        for k, i in enumerate(order):
            assert found[k] == max((common(i, j) for j in range(i)), default=0)


def test_previous_smaller_positions():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        for position in (rng.permutation(n), np.arange(n), np.arange(n)[::-1].copy()):
            before, _ = lpf.previous_smaller(position, np.zeros(n, np.int64))
            stack, wanted = [], []
            for k, p in enumerate(position):
                while stack and position[stack[-1]] > p:
                    stack.pop()
                wanted.append(stack[-1] if stack else -1)
                stack.append(k)
            assert before.tolist() == wanted
