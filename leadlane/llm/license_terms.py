"""Licence names, labels and terms. Public names of licences and words of their usual notices."""

from __future__ import annotations

#: Phrases of words, in lower case, and the label that each names; every place where one stands counts.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Longer or less common phrases, with how sure each is by itself.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "library general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "boost software license": ("bsl", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "licensed under cc by": ("cc-by", 0.8),
    "licensed under cc by sa": ("cc-by-sa", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by nc sa": ("cc-by-nc-sa", 0.9),
    "licensed under cc by nd": ("cc-by-nd", 0.9),
    "licensed under cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons zero": ("cc0", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.95),
    "released under the mit license": ("mit", 0.95),
    "gnu general public license": ("gpl", 0.9),
}

#: How sure a base phrase is by itself, and an identifier tag whose expression can be read.
BASE_WEIGHT = 0.7
TAG_WEIGHT = 0.99

#: The words of an identifier tag, in lower case.
TAG = "spdx-license-identifier:"

#: Label and duty of the licences whose identifier starts so; the longest start counts.
IDENTIFIERS = {
    "mit": ("mit", "permissive"),
    "apache-": ("apache", "permissive"),
    "bsd-": ("bsd", "permissive"),
    "0bsd": ("bsd", "permissive"),
    "isc": ("isc", "permissive"),
    "zlib": ("zlib", "permissive"),
    "bsl-": ("bsl", "permissive"),
    "unlicense": ("unlicense", "permissive"),
    "wtfpl": ("wtfpl", "permissive"),
    "cc0-": ("cc0", "permissive"),
    "cc-by-": ("cc-by", "permissive"),
    "cc-by-sa-": ("cc-by-sa", "strong"),
    "cc-by-nc-": ("cc-by-nc", "restricted"),
    "cc-by-nc-sa-": ("cc-by-nc-sa", "restricted"),
    "cc-by-nd-": ("cc-by-nd", "restricted"),
    "cc-by-nc-nd-": ("cc-by-nc-nd", "restricted"),
    "lgpl-": ("lgpl", "weak"),
    "mpl-": ("mpl", "weak"),
    "epl-": ("epl", "weak"),
    "eupl-": ("eupl", "strong"),
    "gpl-": ("gpl", "strong"),
    "agpl-": ("agpl", "strong"),
}
#: Duties from the lightest to the heaviest.
DUTIES = ("permissive", "weak", "strong", "restricted", "unknown")
#: Exceptions that let other code link to a work under a strong licence.
LINKING_EXCEPTIONS = ("classpath-exception-", "gcc-exception-", "llvm-exception", "linux-syscall-note", "autoconf-exception-", "bison-exception-", "font-exception-")
