"""Digests of the canonical forms of entire licence texts, in their usual wordings (see ``licenses.units``).

Each has the place its text was found at; those "not traced again" came from licence files of software that is no longer installed.
"""

DIGESTS = [
    ("Apache-2.0", "2bb5754beeeb64bdfbed6a57ecf3c5d1", "Node package tunnel-agent, LICENSE"),
    ("Apache-2.0", "2f973fce6821968caa77d834b80cee7c", "Python package packaging, LICENSE.APACHE"),
    ("Apache-2.0", "4225605d4c3647ef2075217a0d52c9ca", "base-files, Apache-2.0"),
    ("Apache-2.0", "58031e164f1bcaafced49bd779aba77e", "not traced again"),
    ("Apache-2.0", "71b2bd815104b9a01c3f714eb505d24b", "not traced again"),
    ("Apache-2.0", "a90697331248535821cbca3716b02146", "Python package requests, LICENSE"),
    ("Apache-2.0", "b345591acc360ff2ef54cdc4bab9317c", "not traced again"),
    ("Apache-2.0", "ba7fbc7298a5e5d558bcf8d99a3a0694", "not traced again"),
    ("Apache-2.0", "ee04bd447a83f57129e91ce889139b3f", "not traced again"),
    ("BSD-2-Clause", "8c19b192342f336853fe3904a8a03dc0", "published text, see tests/llm/license_texts.py"),
    ("BSD-2-Clause", "b0538ec125cafeeb58bf11083985630b", "published text, see tests/llm/license_texts.py"),
    ("BSD-2-Clause", "c8d9da4700de1066e5677793245d6601", "not traced again"),
    ("BSD-3-Clause", "dfd9463b7bcad50bb1270be3d6bf0c2a", "published text, see tests/llm/license_texts.py"),
    ("BSD-3-Clause", "e82046f0b7f72505ecac75064a0d3ab0", "published text, see tests/llm/license_texts.py"),
    ("BlueOak-1.0.0", "3e8824062afab73422504c6031b6342d", "not traced again"),
    ("CC-BY-SA-4.0", "523e1ae67034d876937bf1d3b440b9ea", "not traced again"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48", "base-files, CC0-1.0"),
    ("GFDL-1.2", "c969fdb4b731dadf7173c1ffbe49a117", "base-files, GFDL-1.2"),
    ("GFDL-1.3", "eb6b86c0fad89753a5a36c484fa0ada2", "base-files, GFDL"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea", "base-files, GPL-1"),
    ("GPL-2.0", "2093428d61995d672f88578df15ef451", "not traced again"),
    ("GPL-2.0", "27c2a2d414d0960a8ea0d3941a57dd3b", "not traced again"),
    ("GPL-2.0", "389f4f50cf94c03f3e37ccf42e3b3dc9", "not traced again"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c", "base-files, GPL-2"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7", "not traced again"),
    ("GPL-2.0", "921f117ea150696802f3dbf727ef0dc4", "not traced again"),
    ("GPL-2.0", "a731e56684fe9202ad8f1df5be3645ef", "not traced again"),
    ("GPL-2.0", "bb7e7527c861092329f5ca43b688d331", "not traced again"),
    ("GPL-2.0", "caac9b0ab6e25652c5168ed262f1168e", "not traced again"),
    ("GPL-2.0", "e0b7635c5df0abca544f6e8bbe326fde", "not traced again"),
    ("GPL-2.0", "eb1d1ba759e8eee515fb021452d0b32b", "not traced again"),
    ("GPL-2.0", "f2c06efe640b4a281cbe5337cdde80ab", "not traced again"),
    ("GPL-3.0", "0a259049231d1cb48881826c10334723", "not traced again"),
    ("GPL-3.0", "17e434cc6db7003444b088cb4cc81e91", "not traced again"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca", "not traced again"),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1", "base-files, GPL"),
    ("GPL-3.0", "cbcd0971278be25219f37b6486dcbe3f", "not traced again"),
    ("ISC", "2fe14e4f97063d6bde833c428f33c019", "not traced again"),
    ("ISC", "7d63297d61de6dc68f1a826989710335", "not traced again"),
    ("ISC", "b6ab23f33a368e7f225abed7065c8009", "Node package ini, LICENSE"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a", "base-files, LGPL-2"),
    ("LGPL-2.0", "b2b2c7dac31c74d81c1f4d8da1f08e0b", "not traced again"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee", "not traced again"),
    ("LGPL-2.1", "35149cc0147209ad0af2abd9b7190399", "not traced again"),
    ("LGPL-2.1", "9cf70f8dddb9a4cb1bedd8de5e1228b7", "not traced again"),
    ("LGPL-2.1", "b36e25b5143e3847c68ef1cc20ba0be7", "not traced again"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7", "not traced again"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4", "base-files, LGPL-2.1"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d", "base-files, LGPL"),
    ("MIT", "8f9b17c63a392fc784ef4db4283832d4", "not traced again"),
    ("MIT", "90a17991c3ba7b04d183a6467fbe3449", "Node package better-sqlite3, LICENSE"),
    ("MPL-1.1", "9cdb0c94cb45abb55c616e067859d4ad", "base-files, MPL-1.1"),
    ("MPL-2.0", "7d4b8b0889da3c01eff3fe431102e6d6", "base-files, MPL-2.0"),
    ("MPL-2.0", "d7e5cb5d4031f582f73c7bb44d95d1f6", "installed software"),
    ("OFL-1.1", "db545aa9d6cfb363aba9bb90aa039cf4", "not traced again"),
    ("Unlicense", "0ddb544fc94f1ac376b1b27618cf995a", "published text, see tests/llm/license_texts.py"),
    ("Unlicense", "243d95b52f77dc596a0b9d0b9ba09bb5", "published text, see tests/llm/license_texts.py"),
    ("Unlicense", "3c0fa66ce452e1674dc40c0df1dd055a", "published text, see tests/llm/license_texts.py"),
    ("Zlib", "380f94b95a7b7ac47768cd1c4d543d9d", "published text, see tests/llm/license_texts.py"),
]
