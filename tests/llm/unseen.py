"""Paragraphs of public licences that the training lacks, by family; None: licences outside the families, and ordinary text."""

UNSEEN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and to permit persons to whom the Software is furnished to do so.",
        "Except as contained in this notice, the names of the above copyright holders shall not be used in advertising. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.",
        "You are free to use this library as the MIT license allows.",
    ),
    "Apache-2.0": (
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"). You may not use this file except in compliance with the License. A copy of the License is located at http://aws.amazon.com/apache2.0/",
        "or in the \"license\" file accompanying this file. This file is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL": (
        "This file is part of a program which is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.",
        "The module may be redistributed under GPLv3.",
        "BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW.",
    ),
    "LGPL": (
        "This file is part of a library that is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This package is distributed in the hope that it will be useful, but without any warranty. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL": (
        "it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation",
        "The server is offered under the GNU Affero General Public License.",
    ),
    "BSD": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer in this position and unchanged.",
        "THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met:",
    ),
    "MPL-2.0": (
        "This file is subject to the terms of the Mozilla Public License, v. 2.0. A copy of the MPL can be obtained at https://mozilla.org/MPL/2.0/.",
        "The Covered Software is under the Mozilla Public License, v. 2.0; recipients must be told how they can obtain the Source Code Form.",
    ),
    "CC-BY": ("This article is distributed under the terms of the Creative Commons Attribution 4.0 International License (http://creativecommons.org/licenses/by/4.0/), which permits unrestricted use.",),
    "CC-BY-SA": ("Unless otherwise noted, all pages are available under the Creative Commons Attribution-ShareAlike 4.0 License.",),
    "CC-BY-NC": ("The photographs are shared under a Creative Commons Attribution-NonCommercial 4.0 license.",),
    "public-domain": (
        "The author has dedicated this work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "This is free and unencumbered software, released into the public domain by its authors.",
    ),
    None: (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the author be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "Distributed under the Boost Software License, Version 1.0.", "Use, modification and distribution are subject to the Boost Software License, Version 1.0.",
        "All rights to this program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "This package is covered by the Artistic License.", "Released under the Eclipse Public License 2.0.", "Licensed under the zlib License.",
        "a license to drive a car was all that was asked of the public servant", "this software is free of charge for schools", "the public version of the story, under the terms of the deal",
        "The warranty is void if the seal is broken.", "You may obtain a copy of the report from the office, without conditions.", "The committee granted permission to build a house.",
    ),
}
