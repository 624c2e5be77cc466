from packwright.cli import main

main()
