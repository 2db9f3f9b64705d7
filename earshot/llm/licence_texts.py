"""Public licence texts and notices, in parts without names or years, and their mandatory key phrases."""

from __future__ import annotations

# Label, text, key phrases in lower-cased words.
TEXTS = (
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    (
        "apache-2-header",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ("unless required by applicable law", "without warranties or conditions of any kind"),
    ),
    (
        "agpl-3-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu affero general public license", "version 3"),
    ),
    ("boost-1-notice", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    (
        "boost-1-grant",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:",
        ("any person or organization obtaining a copy of the software", "prepare derivative works"),
    ),
    (
        "bsd-clauses",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    (
        "bsd-disclaimer",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ("copyright holders and contributors as is", "are disclaimed"),
    ),
    (
        "bsd-3-endorsement",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    ("cc-by-nc-4-notice", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    (
        "cc-by-4-notice",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0 international license",),
    ),
    (
        "cc-by-sa-4-notice",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike 4 0 international license",),
    ),
    (
        "cc0-deed",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or "
        "her rights to the work worldwide under copyright law",
        ("dedicated the work to the public domain",),
    ),
    (
        "epl-2-notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        ("eclipse public license",),
    ),
    ("gpl-3-notice", "licensed under the GNU General Public License version 3", ("gnu general public license",)),
    (
        "gpl-2-header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("gnu general public license as published", "version 2"),
    ),
    (
        "gpl-3-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license as published", "version 3"),
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        ("permission to use copy modify and or distribute this software", "appear in all copies"),
    ),
    (
        "lgpl-2-1-header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("gnu lesser general public license as published", "version 2 1"),
    ),
    (
        "lgpl-3-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu lesser general public license as published", "version 3"),
    ),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "mit-warranty",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        ("without warranty of any kind", "noninfringement"),
    ),
    ("mit-notice", "released under the MIT License", ("the mit license",)),
    (
        "mpl-2-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        ("free and unencumbered software", "public domain"),
    ),
    (
        "zlib-grant",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        ("without any express or implied warranty", "authors be held liable"),
    ),
)
