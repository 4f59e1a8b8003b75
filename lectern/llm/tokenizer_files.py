"""Where the public vocabulary files are; the folder is a parameter."""

from __future__ import annotations

import os


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
