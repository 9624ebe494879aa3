"""A git repository as a source: what a push would bring, its diffs, and the lines of a commit."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Repo:
    """One working copy; every command is an argument list, so that nothing is read by a shell."""

    def __init__(self, folder: str, trunk: str = "main") -> None:
        self.folder, self.trunk = folder, trunk

    def git(self, *arguments: str) -> str | None:
        """What git says, or None where it fails."""
        done = subprocess.run(["git", "-C", self.folder, *arguments], capture_output=True, timeout=60)
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None

    def _since_trunk(self, head: str) -> tuple[str, str] | None:
        base = self.git("merge-base", self.trunk, head)
        return base and (base.strip(), head)

    def range_of(self, said: str = "") -> tuple[str, str] | None:
        """(base, head) of ``a..b``; of a branch, or of nothing for the current one, since it left the trunk. None without a common ancestor."""
        first, dots, second = said.partition("..")
        return (first, second.lstrip(".") or "HEAD") if dots else self._since_trunk(said or "HEAD")

    def ranges_of_push(self, lines: Iterable[str]) -> list[tuple[str, str]]:
        """The ranges of a push as git announces it, a line for each ref: local name, local id, remote name, remote id.

        A deleted ref, whose local id is all noughts, brings nothing.  Where the remote id is noughts or unknown here, the
        range begins where the branch left the trunk; without that there is none.
        """
        out = []
        for fields in (line.split() for line in lines):
            if len(fields) != 4 or no_object(fields[1]):
                continue
            _, new, _, old = fields
            known = not no_object(old) and self.git("cat-file", "-e", old) is not None
            if found := (old, new) if known else self._since_trunk(new):
                out.append(found)
        return out

    def diffs(self, spark: SparkSession, ranges: list[tuple[str, str]], context: int = 5) -> DataFrame:
        """(diff_id, base, head, text) of each range; one without changes gives no row."""
        rows = [(i, base, head, self.git("diff", "--no-color", f"--unified={context}", f"{base}..{head}")) for i, (base, head) in enumerate(ranges)]
        return spark.createDataFrame([r for r in rows if r[3]], "diff_id long, base string, head string, text string")

    def lines(self, spark: SparkSession, commit: str) -> DataFrame:
        """(path, line_no, line) of every text file of a commit, from the objects and never the working copy."""
        listed = self.git("grep", "-n", "-I", "-z", "-e", "", commit, "--") or ""
        rows = []
        for entry in listed.split("\n"):
            path, _, rest = entry.removeprefix(f"{commit}:").partition("\0")
            number, _, line = rest.partition("\0")
            if number.isdigit():
                rows.append((path, int(number), line))
        return spark.createDataFrame(rows, "path string, line_no int, line string")


def no_object(sha: str) -> bool:
    """Whether an id stands for nothing, whatever the length of ids."""
    return bool(sha) and not sha.strip("0")
