"""Values that are put together from many parts, over several lines, in brackets, or from names defined below."""

import os
import random
import sys
import time

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from stintflow.llm import secrets

PARTS = ["aQ3", "x7Z", "Lm9", "pR2", "vT8", "kW4", "nB6", "hJ1", "yC5", "gD0", "sF3", "uE7"]


@pytest.mark.parametrize(
    "text",
    [
        "K = " + " + ".join(f'"{p}"' for p in PARTS) + "\npassword = K\n",
        'K = ""\n' + "".join(f'K = K + "{p}"\n' for p in PARTS) + "password = K\n",
        "password = " + " +\n    ".join(f'"{p}"' for p in PARTS) + "\n",
        "password = (\n" + "".join(f'    "{p}"\n' for p in PARTS) + ")\n",
        "password = [" + ", ".join(f'"{p}"' for p in PARTS) + "]\n",
        "password = K\nK = " + " + ".join(f'"{p}"' for p in PARTS) + "\n",
    ],
)
def test_every_part_is_found(text):
    found = {text[a:b] for a, b, _ in secrets.named_spans(text)}
    assert set(PARTS) <= found


def test_names_in_a_ring_end_and_keys_in_braces_are_no_values():
    secrets.named_spans("a = b + c\nb = a\nc = c + b\npassword = a\n")
    text = 'secret = {"username1": "zz"}\n'
    assert "username1" not in {text[a:b] for a, b, _ in secrets.named_spans(text)}


@pytest.mark.parametrize(
    "text",
    [
        'K = ""\n' + "".join(f'K = K + "{PARTS[i % 12]}"\n' for i in range(60_000)) + "password = K\n",
        "".join(f'password = password + "{PARTS[i % 12]}"\n' for i in range(30_000)),
        "".join(f'password{i} = "{PARTS[i % 12] * 3}{i}"\n' for i in range(30_000)),
        "".join(f'v{i} = v{i + 1} + v{i + 2}\n' for i in range(20_000)) + 'v20000 = "aQ3x7ZLm9"\npassword = v0\n',
        "password = [" + ", ".join(f'"{PARTS[i % 12]}"' for i in range(100_000)) + "]\n",
    ],
    ids=["chain", "sensitive chain", "many", "shared", "list"],
)
def test_a_megabyte_takes_seconds(text):
    begin = time.monotonic()
    spans = secrets.spans_of(text)
    assert spans and time.monotonic() - begin < 15


def test_long_names_are_read_from_their_start():
    name = "password_" + "x" * 500
    for text in (f'{name} = "aQ3x7ZLm9pR2"', f'd["{name}"] = "aQ3x7ZLm9pR2"', f'{name}: {"T" * 300} = "aQ3x7ZLm9pR2"', f'"{name}": "aQ3x7ZLm9pR2"'):
        assert [text[a:b] for a, b, _ in secrets.named_spans(text)] == ["aQ3x7ZLm9pR2"], text


def test_joined_values_score_as_the_text_itself():
    rng = random.Random(5)
    pieces = ["", " ", "  ", "a", "aB3", "exam", "ple", "x", "xx", "none", "undef", "ined", "your", "_", "\t", "é", "pR2vT8", "a b", " q", "q ", "place", "holder", "."]
    for _ in range(20_000):
        parts = [rng.choice(pieces) for _ in range(rng.randint(0, 7))]
        whole = secrets.Joined()
        for part in parts:
            whole.add(secrets.Joined(part))
        assert whole.score() == pytest.approx(secrets.literal_score("".join(parts))), parts


def test_values_equal_a_plain_evaluation():
    """Texts of assignments without rings or shared names, against values written out in full."""
    rng = random.Random(8)
    for _ in range(400):
        names, texts, lines, wanted = [], {}, [], {}
        for i in range(rng.randint(1, 8)):
            name = rng.choice(["password", "key", "title", "secret"]) + f"_v{i}"
            parts, holds, free = [], [], [n for n in names if n not in {x for t in texts.values() for x in t[1]}]
            for _ in range(rng.randint(1, 4)):
                if free and rng.random() < 0.4:
                    parts.append(free.pop(rng.randrange(len(free))))
                    holds.append(parts[-1])
                else:
                    parts.append('"' + "".join(rng.choice("aQ3x7ZLm9 ") for _ in range(rng.randint(1, 9))) + f'{i}"')
            texts[name] = (parts, holds)
            names.append(name)
            lines.append(f"{name} = " + " + ".join(parts))
        text = "\n".join(lines) + "\n"

        def literals(name):
            return [x for p in texts[name][0] for x in (literals(p) if p in texts else [(name, p)])]

        for name in names:
            its = literals(name)
            whole = secrets.literal_score("".join(p[1:-1] for _, p in its))
            for at in its:
                piece = at[1][1:-1]
                score = secrets.name_score(name) * max(secrets.literal_score(piece), whole if len(piece) > 2 else 0.0)
                wanted[at] = max(score, wanted.get(at, 0.0))
        want = sorted((p[1:-1], round(v, 9)) for (_, p), v in wanted.items() if v >= secrets.LEAST_SCORE)
        got = sorted((text[a:b], round(v, 9)) for a, b, v in secrets.named_spans(text))
        assert {g for g in got} == {w for w in want}, text
