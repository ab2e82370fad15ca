import sys

from specula.cli import main

sys.exit(main())
