"""Notices by which licence families announce themselves (fixed values)."""

TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
}

#: Notices of licences outside these families, by which the class ``unknown`` is learned (fixed values).
UNLISTED: list[str] = [
    'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    "This file is distributed under the ISC license.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "This font software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at the web site.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Microsoft Public License. By using the software you accept this license. If you do not accept the license, do not use the software.",
    "Use of this software is subject to the terms of the license agreement that accompanies it.",
    "This software may be used and distributed according to the terms of the license agreement.",
    "Released under the terms of the Python Software Foundation License.",
    "The source code is available under a custom license; see the file COPYING for the terms and conditions of use, reproduction and distribution.",
    "Contains public sector information licensed under the Open Government Licence v3.0.",
    "This software is governed by the CeCILL licence under French law and abiding by the rules of distribution of free software.",
    "Licensed under the Sun Public License, version 1.0.",
    "Licensed under the Open Software Licence, version 3.0.",
    "Released under the PHP License, version 3.01.",
    "You may use and distribute this program under the terms of the Q Public License.",
    "This data is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License.",
]

#: What stands before and after the name of any licence.
GRANTS = [
    "Licensed under the", "Released under the", "Distributed under the", "Available under the", "This file is licensed under the", "This work is published under the",
    "This program is released under the terms of the", "You may use this software under the terms of the", "Subject to the terms of the", "Use is governed by the",
]
LICENCES = [
    "License.", "Licence.", "Public License.", "Public Licence.", "Software License.", "Public License, version 1.2.", "Public Licence, version 1.1.", "License, Version 2.0.",
    "Licence, version 3.0.", "Public License v. 2.1.", "Software License, version 1.0.", "license. See the license file for details.",
]

#: Ordinary sentences with the words of notices, which are none.
ORDINARY: list[str] = [
    "Copyright (c) 2020 the authors.",
    "Copyright 2019 by the company and its contributors",
    "She lost her driving license and had to ask for a new one at the office.",
    "The restaurant was given a license to sell wine in the summer.",
    "He asked for permission to leave the room and was granted an hour.",
    "The software is used for many purposes, and its source code is read by students.",
    "A warranty of two years is included with this washing machine.",
    "The court spoke about copyright and the rights of authors in the case.",
    "The terms of the agreement were published by the foundation in any case.",
    "You can use this recipe without any changes and copy it for your friends.",
]
