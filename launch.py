"""Entry point for spark-submit; see :mod:`stratasift.__main__`."""

from stratasift.__main__ import main

if __name__ == "__main__":
    main()
