"""python -m glosswork FILE..."""

from .cli import main

raise SystemExit(main())
