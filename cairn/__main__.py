"""python -m cairn"""

import sys

from cairn.cli import main

sys.exit(main())
