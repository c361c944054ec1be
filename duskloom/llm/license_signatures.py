"""Hand-written signatures of licence bodies and notices, over lower-case words with one blank between them.

label, keyword (a word that every match has), pattern. Sentences that several licences share carry the label of their family.
"""

from __future__ import annotations

BODIES: list[tuple[str, str, str]] = [
    # MIT and its kin
    ("mit", "restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-0", "restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software [a-z0-9 ]{0,80}to deal in the software without restriction [a-z0-9 ]{0,200}to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-modern", "fees", "permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("hpnd", "fee", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "distribute", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and (?:the author|isc|[a-z]+) disclaims all warranties with regard to this software"),
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("curl", "third", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement of third party rights"),
    ("icu", "appear", "permission is hereby granted free of charge [a-z0-9 ]{0,200}provided that the above copyright notice s and this permission notice appear in all copies"),
    ("ntp", "advertising", "permission to use copy modify and distribute this software and its documentation [a-z0-9 ]{0,120}is hereby granted [a-z0-9 ]{0,200}not be used in advertising or publicity"),
    # BSD
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "endorse", "neither the name of [a-z0-9 ]{1,120}nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "regents", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", "exemplary", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", "patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants [a-z0-9 ]{0,160}patent license"),
    ("bsd-3-clause-lbnl", "upgrades", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance"),
    # Apache
    ("apache-2.0", "compliance", "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", "writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "reproduction", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2.0", "patent", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable [a-z0-9 ]{0,60}patent license"),
    ("apache-1.1", "foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", "this product includes software developed by the apache group"),
    # GNU
    ("gpl-1.0", "foundation", "under the terms of the gnu general public license as published by the free software foundation either version 1"),
    ("gpl-2.0", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-2.0", "foundation", "under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3.0", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl-3.0", "license", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "license", "gnu general public license version 2 june 1991"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "license", "(?:either )?version 3 of the license or at your option any later version"),
    ("gpl-2.0", "license", "(?:either )?version 2 of the license or at your option any later version"),
    ("lgpl-2.1", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2.0", "library", "under the terms of the gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", "library", "you should have received a copy of the gnu library general public license along with"),
    ("lgpl-3.0", "supplemented", "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions"),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", "remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", "under the terms of the gnu free documentation license [a-z0-9 ]{0,120}with no invariant sections"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath-exception", "modules", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gcc-exception", "runtime", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    # Mozilla, Eclipse, Sun
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl", "netscape", "the contents of this file are subject to the netscape public license"),
    ("mpl", "secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license 2 0"),
    ("epl", "accompanying", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "common", "the accompanying program is provided under the terms of this common public license"),
    ("cddl", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "cddl", "the contents of this file are subject to the terms of the cddl"),
    ("cddl", "header", "when distributing covered code include this cddl header in each file"),
    ("sissl", "sun", "the contents of this file are subject to the sun industry standards source license"),
    ("apsl", "apple", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("cpal", "attribution", "the contents of this file are subject to the common public attribution license"),
    ("qpl", "license", "this file may be distributed under the terms of the q public license"),
    # permissive one-offs
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "png", "the png reference library is supplied as is"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ftl", "freetype", "portions of this software are copyright [a-z0-9 ]{0,20}the freetype project"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("php", "php", "this product includes php software freely available from"),
    ("psf", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python", "cnri", "cnri hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python", "beopen", "beopen python open source license agreement"),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "deal", "permission is hereby granted free of charge [a-z0-9 ]{0,160}to deal with the software without restriction"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("ruby", "bsdl", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl [a-z0-9 ]{0,40}or the conditions below"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("w3c", "obtaining", "by obtaining using and or copying this work you [a-z0-9 ]{0,40}agree that you have read understood and will comply with the following terms"),
    ("unicode", "unicode", "unicode inc grants [a-z0-9 ]{0,60}license to use copy"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("lppl", "latex", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "reserved", "no modified version of the font software may use the reserved font name"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("ms-pl", "accept", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("afl", "academic", "licensed under the academic free license version"),
    ("osl", "software", "licensed under the open software license version"),
    ("ecl-2.0", "educational", "licensed under the educational community license version 2 0"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("upl-1.0", "condition", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("mulan-psl-2.0", "mulan", "you can use this software according to the terms and conditions of the mulan psl v2"),
    ("zpl", "zope", "this software is subject to the provisions of the zope public license"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("cecill", "cecill", "this software is governed by the cecill [a-z0-9 ]{0,20}license under french law"),
    # public domain
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software [a-z0-9 ]{0,120}for any purpose"),
    ("unlicense", "heirs", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc0-1.0", "extent", "to the extent possible under law [a-z0-9 ]{1,80}has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights to"),
    ("public-domain", "domain", "(?:this (?:work|file|code|software)|it) is (?:hereby )?(?:in|placed (?:in|into)|released (?:in|into)|dedicated to) the public domain"),
    ("public-domain", "claimed", "no copyright is claimed and it may be freely distributed and copied"),
    ("public-domain", "disclaimed", "the author disclaimed copyright to this source code"),
    ("sqlite-blessing", "blessing", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    # Creative Commons and data
    ("cc-by", "attribution", "this work is licensed under a creative commons attribution (?:[0-9] [0-9] )?(?:international |unported )?license"),
    ("cc-by-sa", "commons", "this work is licensed under a creative commons attribution share ?alike"),
    ("cc-by-nc", "commons", "this work is licensed under a creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons", "this work is licensed under a creative commons attribution no ?deriv"),
    ("creative-commons", "creativecommons", "to view a copy of this license visit https? creativecommons org licenses"),
    ("creative-commons", "creativecommons", "creativecommons org licenses by(?: nc)?(?: sa| nd)? [0-9] [0-9]"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("odbl-1.0", "database", "this [a-z0-9 ]{1,60}is made available under the open database license"),
    ("odc-by-1.0", "attribution", "made available under the open data commons attribution license"),
    ("pddl-1.0", "dedication", "made available under the public domain dedication and license"),
    # source available
    ("busl-1.1", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", "the license does not grant to you the right to sell the software"),
    ("polyform", "licensor", "the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe"),
    ("openrail", "derivatives", "you agree not to use the model or derivatives of the model [a-z0-9 ]{0,40}in any way that violates"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary) (?:information|unauthorized|all rights)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work) [a-z0-9 ]{0,60}strictly prohibited"),
    ("all-rights-reserved", "reserved", "(?:copyright [a-z0-9 ]{0,80})?all rights reserved"),
    # how files point to a licence
    ("see-license", "accompanying", "see the accompanying license file for terms"),
    ("see-license", "license", "use of this source code is governed by an? [a-z0-9]+ style license that can be found in the license file"),
    ("mit", "governed", "use of this source code is governed by an mit style license"),
    ("bsd", "governed", "use of this source code is governed by a bsd style license"),
    ("mit", "found", "this source code is licensed under the mit license found in the license file in the root directory"),
]
