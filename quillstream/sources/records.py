"""A small archive of Markdown records, made by rule, with questions about it; for tests and trials. All of it is invented."""

from __future__ import annotations

import random
from pathlib import Path

CHAPELS, KINDS = ("lanterna", "corda", "studio"), ("photo", "drawing", "contract", "report")
SUBJECTS = ("vault", "lacuna", "azurite", "plaster", "gilding", "signature", "fresco", "ribs", "varnish", "lifting")


def write_archive(folder: Path, records: int = 15, seed: int = 22, force: bool = False) -> list[tuple[str, str]]:
    """Write ``records`` records and give (question, record id) about each that is current; every fifth is superseded by the one after it.

    An existing archive is left alone unless ``force``, which replaces its records.
    """
    folder.mkdir(parents=True, exist_ok=True)
    if old := list(folder.glob("*.md")):
        if not force:
            raise FileExistsError(folder)
        for f in old:
            f.unlink()
    rng, asked = random.Random(seed), []
    for n in range(records):
        name, subject, size = f"rec-{n:03d}", SUBJECTS[n % len(SUBJECTS)], rng.randrange(20, 900)
        superseded = f"rec-{n + 1:03d}" if n % 5 == 3 and n + 1 < records else ""
        head = {"id": name, "title": f"The {subject} of bay {n}", "chapel": CHAPELS[n % 3], "kind": KINDS[n % 4], "dated": 1500 + 7 * n, "superseded_by": superseded}
        said = f"The {subject} of bay {n} measures {size} mm. It was looked at in {1900 + n} by hand {rng.randrange(10)}."
        parts = [f"# The {subject} of bay {n}", "", "## Subject", said, "", "## Condition", f"{rng.randrange(2, 60)} percent is {rng.choice(('sound', 'lost', 'retouched'))}, mostly near the {rng.choice(SUBJECTS)}."]
        (folder / f"{name}.md").write_text("---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + "---\n" + "\n".join(parts) + "\n")
        if not superseded:
            asked.append((f"How large is the {subject} of bay {n}?", name))
    return asked
