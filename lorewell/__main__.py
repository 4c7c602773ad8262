import sys

from .memory import main

sys.exit(main(sys.argv[1:]))
