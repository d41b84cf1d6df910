import sys

from frameledger.cli import main

sys.exit(main())
