"""``python -m lumiquery``."""

import sys

from .cli import main

sys.exit(main())
