"""`python -m veilframe run INPUT OUTPUT`."""

import sys

from .service import main, plain_logs

plain_logs()
sys.exit(main())
