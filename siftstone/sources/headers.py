"""How mails are parsed: by the library's default policy, with a header's value parsed once.

The library parses a header anew each time it is read, and reads content types some ten times a part.
"""

from __future__ import annotations

import email.policy
import functools
from email.headerregistry import HeaderRegistry

# Parsed headers kept by a worker, and the longest that are kept.
KEPT, LONGEST = 1000, 1000

_parse = HeaderRegistry()
_kept = functools.lru_cache(KEPT)(_parse)


def _header(name: str, value: str):
    return _kept(name, value) if len(value) <= LONGEST else _parse(name, value)


POLICY = email.policy.default.clone(header_factory=_header)
