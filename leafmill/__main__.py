"""python -m leafmill FILE...: a preview of files on the console, without Spark."""

from __future__ import annotations

import sys

from leafmill.kernel.document import parse

SHOWN = 400


def preview(path: str) -> str:
    """Status, metadata, and the beginning of each page's runs."""
    with open(path, "rb") as f:
        found = parse(f.read())
    lines = [f"{path}: {found['status']}, version {found['version']}, {len(found['pages'])} pages" + (f" ({found['error']})" if found["error"] else "")]
    lines += [f"  {k}: {v}" for k, v in found["metadata"].items() if v]
    for page in found["pages"]:
        text = " ".join(r["text"] for s in page["streams"] for r in s)
        lines.append(f"  page {page['page_number']} ({page['width']:g} x {page['height']:g}, {len(page['images'])} images): {text[:SHOWN]}")
    return "\n".join(lines)


if __name__ == "__main__":
    for name in sys.argv[1:]:
        print(preview(name))
