"""Short licence notices that license_scan looks for."""

# Label, edits allowed, and the notice's words in lower case.
NOTICES = """
gpl-like      3  gnu general public license
lgpl-like     3  gnu lesser general public license
apache-like   2  apache license version
mit-like      1  mit license
mpl-like      2  mozilla public license
bsd-like      1  bsd license
reserved-like 2  all rights reserved
cc-like       3  creative commons attribution
mit-like      2  spdx license identifier mit
apache-like   3  spdx license identifier apache 2 0
gpl-like      3  spdx license identifier gpl 2 0
gpl-like      3  spdx license identifier gpl 3 0
lgpl-like     3  spdx license identifier lgpl 2 1
bsd-like      3  spdx license identifier bsd 2 clause
bsd-like      3  spdx license identifier bsd 3 clause
mpl-like      3  spdx license identifier mpl 2 0
isc-like      2  spdx license identifier isc
cc0-like      3  spdx license identifier cc0 1 0
mit-like      6  permission is hereby granted free of charge to any person obtaining a copy of this software
bsd-like      6  redistribution and use in source and binary forms with or without modification are permitted
isc-like      6  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
gpl-like      6  this program is free software you can redistribute it and or modify it under the terms of the gnu
apache-like   4  licensed under the apache license version 2 0
mpl-like      6  this source code form is subject to the terms of the mozilla public license v 2 0
unlicense-like 6 this is free and unencumbered software released into the public domain
cc-like       5  this work is licensed under a creative commons
warranty-like 6  the software is provided as is without warranty of any kind
"""


def notices() -> list[tuple[str, str, int]]:
    """(phrase, label, edits)."""
    rows = [line.split(maxsplit=2) for line in NOTICES.strip().splitlines()]
    return [(phrase, label, int(edits)) for label, edits, phrase in rows]
