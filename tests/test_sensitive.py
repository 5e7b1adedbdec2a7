import random
import re

from quernstone.config import SENSITIVE_PATTERNS
from quernstone.operators.answer import HINTS


def test_what_fits_a_sensitive_pattern_has_its_hint():
    r = random.Random(5)
    pieces = ["A", "a", "-", " ", "1", "23", "4567", "1234567", "0123456789", "ABC", "x", "_", "é", "\n", "123-45-6789", "12-34", "0123456789012", "ABC0123456789", *"passport Pasaporte PASSEPORT passaporto pasaport ReisePass number no. : #AB12".split()]
    fit = dict.fromkeys(SENSITIVE_PATTERNS, 0)
    for _ in range(40_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 6)))
        for kind, pattern in SENSITIVE_PATTERNS.items():
            if re.search(pattern, text, re.ASCII):
                fit[kind] += 1
                assert re.search(HINTS[kind], text), (kind, text)
    assert set(HINTS) == set(SENSITIVE_PATTERNS) and min(fit.values()) > 20, fit
