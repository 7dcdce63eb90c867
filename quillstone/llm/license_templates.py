"""Notices and titles of the usual licences, and the SPDX identifiers that name them.

Names are SPDX identifiers; versions of the GNU and Creative Commons licences share one name. The conditions that all BSD texts
begin with stand for BSD-3-Clause; a title or an identifier tells BSD-2-Clause.
"""

#: (licence, text)
NOTICES = [
    ("0BSD", "BSD Zero Clause License"),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "governed by a BSD-style license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BUSL-1.1", "Business Source License 1.1"),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. Public domain CC0"),
    ("CDDL-1.0", "Common Development and Distribution License Version 1.0"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EUPL", "European Union Public Licence V. 1.2"),
    ("EUPL", "Licensed under the EUPL, Version 1.2"),
    ("EUPL", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at"),
    ("GFDL", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GFDL", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("MIT", "governed by an MIT-style license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MS-PL", "Microsoft Public License (Ms-PL)"),
    ("MS-RL", "Microsoft Reciprocal License (Ms-RL)"),
    ("MulanPSL-2.0", "Licensed under Mulan PSL v2. You can use this software according to the terms and conditions of the Mulan PSL v2"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("OSL-3.0", "Licensed under the Open Software License version 3.0"),
    ("PostgreSQL", "PostgreSQL License"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("proprietary", "All rights reserved"),
    ("PSF-2.0", "Python Software Foundation License Version 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("UPL-1.0", "The Universal Permissive License (UPL), Version 1.0"),
    ("Vim", "VIM License"),
    ("WTFPL", "Do What The F*ck You Want To Public License Version 2, December 2004"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Zlib", "zlib License"),
    ("ZPL-2.1", "Zope Public License (ZPL) Version 2.1"),
]

#: Identifiers that are names of their own.
SPDX = [
    "0BSD", "AFL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "BUSL-1.1", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "ISC", "LPPL-1.3c", "MIT", "MIT-0",
    "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Unlicense", "UPL-1.0", "Vim", "WTFPL", "X11", "Zlib", "ZPL-2.1",
]
#: Names that cover several identifiers.
FAMILIES = {
    "AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "CC-BY": ["CC-BY-3.0", "CC-BY-4.0"], "CC-BY-NC": ["CC-BY-NC-3.0", "CC-BY-NC-4.0"], "CC-BY-NC-SA": ["CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"],
    "CC-BY-ND": ["CC-BY-ND-3.0", "CC-BY-ND-4.0"], "CC-BY-SA": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"], "EUPL": ["EUPL-1.1", "EUPL-1.2"], "GFDL": ["GFDL-1.2", "GFDL-1.3", "GFDL-1.3-or-later"],
    "GPL": ["GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0+", "LGPL-3.0-only", "LGPL-3.0-or-later"],
}
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {i}") for name, ids in [*((x, [x]) for x in SPDX), *FAMILIES.items()] for i in ids]
