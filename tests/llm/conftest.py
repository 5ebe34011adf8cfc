import pytest


@pytest.fixture(scope="session")
def texts():
    """Families of near copies, exact copies, empty, null and long texts."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for size in (4, 7, 12, 30, 80, 200, 900):
        for _ in range(6):
            base = [r.choice(vocabulary) for _ in range(size)]
            out.append(" ".join(base))
            for rate in (0.0, 0.01, 0.02, 0.04):
                w = [r.choice(vocabulary) if r.random() < rate else x for x in base]
                if r.random() < 0.5:
                    w = w[: max(1, len(w) - r.randint(0, max(1, size // 20)))]
                out.append(" ".join(w) + r.choice(["", ".", " \n"]))
    return [*out, "", None, "   ", "One", "one", "\n\n", "x " * 30_000]
