"""Entry script for spark-submit."""

from packwright.cli import main

if __name__ == "__main__":
    main()
